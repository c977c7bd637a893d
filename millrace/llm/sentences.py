"""Sentence units of documents in any script, by semi-Markov dynamic programming.

A document is divided at blank lines; lists give one unit per item.  In every
other block the possible ends of a sentence (end marks with their closing quotes
and brackets, blanks in Thai) are candidates, and a dynamic program chooses the
sequence of whole spans with the best total score.  A span is scored jointly by

* its closing word: abbreviations, initials, ordinals, or words that end texts;
* the opening word of the next span: how much likelier it opens a text than
  stands inside one, and its case where the block uses case at all;
* quotation and brackets: a cut inside a pair costs much, and after a closing
  quote the score depends on where in its span the quotation began (a quotation
  that opens the span is followed by its speaker, one after a colon ends it);
* its length: a lone word before an ellipsis is no sentence.

The program is exact: every earlier cut is a possible start of a span.  What a
span gains or loses is constant over ranges of starts (before or after the
quotation that it closes) but for spans of a few characters, so a running best
stands for a range and the cost stays linear in the text.

Opening and closing words are counted over all documents (combined per batch
before the shuffle); the commonest ``MODEL_WORDS`` of them form the model, which
bounds what reaches the driver at every size of the corpus.

Defined results: null and blank texts have no unit; offsets are code points of
the text as stored; outer blanks and byte-order marks belong to no unit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_WORDS = 100_000
_HELD = 1 << 24  # characters counted before the counts are sent on
_SHORT = 16  # a span of at most so many characters is looked at as a whole
#: Abbreviations that do not end a sentence, and those that may.
NEVER = frozenset(
    "mr mrs ms dr prof st vs e.g i.e fig figs sec no nos approx incl p pp ch vol eq ed eds cf al messrs sr jr hon rev gen col capt "
    "ca bzw abb abschn nr z d b s u a evtl ggf inkl vgl hr fr tel m mm mme mlle env n ex art chap sra srta dra pág pag núm num aprox ej "
    "jan feb mar apr jun jul aug sept oct nov dec см рис табл ок мин т г ул стр им тыс млн руб др гл د डॉ नं श्री".split()
)
EITHER = frozenset("etc usw p.m a.m ff u.s d.c inc ltd co corp".split())
_END = ".!?…。！？।॥۔؟｡‼⁇⁈⁉"
_HARD = "。！？।॥؟｡‼⁇⁈⁉"
_CLUSTER = re.compile(rf"[{_END}]+")
_OPEN = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›"}
_CLOSE = frozenset("»”“」』)）]】》›\"")
_QUOTES = frozenset("«“„「『\"")
_BREAK = r"(?:\r\n|\r(?!\n)|(?<!\r)\n|[\u2028\x85])"
_BLANK_LINE = re.compile(rf"{_BREAK}[^\S\n\r\u2028\x85]*{_BREAK}\s*|\u2029\s*")
_BREAKS = re.compile("[\n\r\u2028\x85\u2029]")
_BULLET = re.compile(r"[ \t　\xa0﻿]*[-*•‣·–][ \t\xa0]+")
_NUMBER = re.compile(r"[ \t　\xa0﻿]*(\d{1,4})[.)][ \t\xa0]+")
_LINE = re.compile(_BREAK)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_OPENING_WORD = re.compile("[^\\s,;:!?…\"“”»«()]*")
_LEAD = " \t\r\n　\xa0\"'“”„«»‹›「『（(¿¡‘’[*-•—–"
#: Words before an ordinal number.
_ORDINAL = re.compile(r"(?<!\w)(?:am|der|die|das|den|dem|des|vom|zum|zur|im|beim|ab|bis|seit|jeder|jede|jedes)\s+\d+\Z", re.I)
_PAIRED = re.compile("[" + re.escape("".join(sorted({*_OPEN, *_CLOSE}))) + "]")
_THAI = re.compile("[\u0e00-\u0e7f]")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1 << 16)
def _clean(word: str) -> str:
    if word.isascii():
        return word.lower()
    if "Ã" in word or "ã" in word or "Â" in word:
        try:
            word = word.replace("ã", "Ã").encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", word).lower()


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _is_thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _opening(text: str, at: int, end: int) -> str:
    """The key of the word that stands at ``at``: a lower-cased word, '0' for a number, two characters of an unspaced script."""
    while at < end and text[at] in _LEAD:
        at += 1
    if at >= end:
        return ""
    if _is_cjk(text[at]):
        return text[at : at + 2]
    if text[at].isdigit():
        return "0"
    return _clean(_OPENING_WORD.match(text, at, end)[0].rstrip("."))


def _closing(text: str, at: int, start: int) -> str:
    """The token that ends at ``at`` (its last full stop not included), lower-cased; digits as '0'."""
    if at <= start or text[at - 1].isspace():
        return ""
    low = max(start, at - 64)
    while low > start and not text[low - 1 : at].split(None, 1)[1:]:  # a longer token
        low = max(start, low - (at - low))
    token = text[low:at].rsplit(None, 1)[-1]
    if not token.isalnum():
        token = token[1 + max(token.rfind(c) for c in '(["“„«') :]
        return _DIGITS.sub("0", _clean(token))
    return _clean(token) if token.isalpha() else _DIGITS.sub("0", _clean(token))


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """``start, end, is_item`` of every block and list item."""
    at = 0
    breaks = _BLANK_LINE.finditer(text) if _BREAKS.search(text) else ()
    for m in [*breaks, None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            yield from _items(text, at, end)
        at = m.end() if m else end


def _items(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    while start < end and text[start] in "\r\n \x85":
        start += 1
    number = _NUMBER.match(text, start, end)
    bullet = _BULLET.match(text, start, end)
    if not bullet and not (number and int(number[1]) in (0, 1)):
        yield start, end, False
        return
    lines = [start] + [m.end() for m in _LINE.finditer(text, start, end)]
    heads, count = [], int(number[1]) - 1 if number else 0
    for at in lines:
        n = _NUMBER.match(text, at, end)
        if bullet and _BULLET.match(text, at, end):
            heads.append(at)
        elif number and n and int(n[1]) == count + 1:
            heads.append(at)
            count += 1
    for a, b in zip(heads, [*heads[1:], end], strict=True):
        yield a, b, True


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Closing position -> opening position of quotes and brackets.

    A straight quote after a blank and before none always opens; one that is open
    already was never closed and is dropped, so a lone mark encloses nothing.
    """
    stack: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for m in _PAIRED.finditer(text, start, end):
        i, c = m.start(), m[0]
        if c == '"' and i + 1 < end and (i == start or text[i - 1].isspace()) and not text[i + 1].isspace():
            stack = [x for x in stack if x[0] != '"']
            stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            o, p = stack[k]
            if (c == '"' and o == '"') or (c in _OPEN.get(o, "") and c != '"'):
                out[i] = p
                del stack[k:]
                break
        else:
            if c in _OPEN or c == '"':
                stack.append((c, i))
    return out


class _Nesting:
    """Answers in logarithmic time whether a place lies within a pair."""

    def __init__(self, pairs: dict[int, int]) -> None:
        both = sorted((o, c) for c, o in pairs.items())
        self.opens = [o for o, _ in both]
        self.reach = list(accumulate((c for _, c in both), max))

    def reaches(self, at: int) -> int:
        """The farthest closing place of the pairs that open before ``at``."""
        k = bisect_left(self.opens, at)
        return self.reach[k - 1] if k else -1


@dataclass
class Model:
    """Corpus counts of words that open texts, stand inside, and of tokens with a full stop at the end of texts or inside."""

    start: dict[str, int] = field(default_factory=dict)
    inside: dict[str, int] = field(default_factory=dict)
    final: dict[str, int] = field(default_factory=dict)
    stopped: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.n_start, self.n_inside = sum(self.start.values()) + 1, sum(self.inside.values()) + 1
        # scores looked up so far: each is a function of a counted word, of which there are at most MODEL_WORDS
        self._opens: dict[str, float] = {}
        self._closes: dict[str, float] = {}

    def opens(self, key: str) -> float:
        """Log odds that the word opens a text rather than stands inside one, within [-4, 3]; unknown words 0."""
        if key not in self.start and key not in self.inside:
            return 0.0
        v = self._opens.get(key)
        if v is None:
            v = self._opens[key] = self._open_odds(key)
        return v

    def _open_odds(self, key: str) -> float:
        s, i = self.start.get(key, 0), self.inside.get(key, 0)
        if s + i < 4:
            return 0.0
        return max(-4.0, min(3.0, math.log((s + 0.1) / self.n_start) - math.log((i + 0.5) / self.n_inside)))

    def closes(self, token: str) -> float:
        v = self._closes.get(token)
        if v is None:
            v = self._close_score(token)
            if token in self.final or token in self.stopped:
                self._closes[token] = v
        return v

    def _close_score(self, token: str) -> float:
        bare = token.rstrip(".")
        if bare in EITHER:
            return 0.0
        if bare in NEVER or (len(bare) == 1 and bare.isalpha() and not _is_cjk(bare) and not _is_thai(bare)):
            return -6.0
        f, s = self.final.get(token, 0), self.stopped.get(token, 0)
        if f == 0 and s >= 8 and len(bare) <= 8:
            return -4.0
        return 1.5 if f else 0.0


@dataclass(slots=True)
class _Cut:
    end: int  # end of the span before
    next: int  # start of the span after
    score: float
    quote: int = -1  # opening position of the quotation that closes here
    bracket: int = -1  # opening position of the bracket that closes here, in a block without capitals


def _cuts(text: str, start: int, end: int, model: Model) -> list[_Cut]:
    pairs = _pairs(text, start, end)
    nesting = _Nesting(pairs) if pairs else None
    block = text[start:end]
    lower = block == block.lower()
    out: list[_Cut] = []

    for m in _CLUSTER.finditer(text, start, end):
        mark, e = m[0], m.end()
        quote = bracket = -1
        while True:  # closing quotes and brackets belong to the span; French ones after a blank
            k = e
            while k < end and text[k] in " \xa0 " and k - e < 2:
                k += 1
            if e < end and e in pairs and pairs[e] < m.start():
                if text[pairs[e]] in _QUOTES:
                    quote = pairs[e]
                else:
                    bracket = pairs[e]
                e += 1
            elif k < end and k > e and k in pairs and text[k] in "»" and pairs[k] < m.start():
                quote = pairs[k]
                e = k + 1
            elif quote >= 0 and e < end and text[e] in ".。":
                e += 1
            else:
                break
        nxt = e
        while nxt < end and (text[nxt].isspace() or text[nxt] == "﻿"):
            nxt += 1
        if nxt >= end:
            continue
        spaced = nxt > e
        c = text[nxt]
        if text[nxt] in ",;:，；：、،؛" or (text[nxt] in _CLOSE and text[nxt] not in _OPEN and nxt in pairs):
            continue
        first = nxt
        while first < end and text[first] in _LEAD:
            first += 1
        head = text[first] if first < end else c
        key = _opening(text, nxt, end)
        opens = model.opens(key)
        dot = mark[-1] == "." and "…" not in mark and len(mark) == 1
        ellipsis = "…" in mark or (set(mark) == {"."} and len(mark) > 1)
        if dot:
            token = _closing(text, m.start(), start)
            if not spaced and quote < 0:
                # no blank: a file name, an abbreviation, a number, or two sentences run together
                before = token[-1:] if token else ""
                tail = re.search(r"[^\W_]*$", token)[0]
                joined = (len(tail) >= 2 and tail.isalpha() or tail == "0" or token in ("p.m", "a.m")) and "_" not in token
                joined = joined and (head.isupper() and (text[first + 1 : first + 2].islower() or text[first + 1 : first + 2] in ("Ã", "Â") or not text[first + 1 : first + 2].isalpha()) or lower and opens > 0 or head.isdigit() and c not in "0123456789" or _is_cjk(head) or c in _QUOTES)
                if head.isdigit() and c.isdigit():
                    joined = len(tail) >= 2 and tail.isalpha() and model.final.get(token, 0) > 0 and bool(re.match(r"\d+ ", text[nxt : nxt + 6]))
                if not joined or not before or (not c.isalnum() and c not in _QUOTES and c not in "(¿¡"):
                    continue
                if not lower and head.isupper() and opens <= -4:
                    continue
            s = model.closes(token) if quote < 0 else 1.0
            if token == "0":
                s = -4.0 if _ORDINAL.search(text, max(start, m.start() - 24), m.start()) else 0.0
            if head.isdigit():
                s += 1.0 if model.closes(token) > 0 or token in EITHER else max(opens, -1.0)
            elif head.isupper():
                s += 2.0 + (opens if opens < 0 else 0.5)
            elif head.islower():
                s += opens + 0.2 if lower else -5.0
            elif _is_cjk(head) or head.isalpha():
                s += 1.5 + min(opens, 0.0) / (1 if quote >= 0 else 2)
            else:
                s += 1.0
            if token and token[-1:] and not token[-1].isalnum() and quote < 0 and token[-1] not in ")]%\"”»’":
                s -= 1.0
        elif ellipsis:
            s = 1.5
            if head.islower():
                s += opens if lower else -6.0
                if model.opens(_closing(text, m.start(), start)) >= 2:
                    s -= 5.0  # an interjection that opens its sentence
            elif head.isupper():
                s += 2.0
            else:
                s += 3.0 if _is_cjk(head) else 1.0
        else:
            s = 4.0
            if head.islower() and quote < 0:
                s += min(opens, 0.0) if lower else -5.0
            if not spaced and mark[-1] in "!?" and not (head.isalnum() or c in _LEAD):
                continue
        if quote >= 0:
            # what follows a quotation decides; its place in the span is scored in the program
            s = {True: 2.5, False: 0.0}[head.isupper() or c in "“„«「"] if not head.islower() else 0.0
            if head.islower():
                s += (opens if opens > 0 else opens - 1.0) if lower else -5.0
            elif not head.isupper() and head.isalpha():
                s += min(opens, 1.0) if opens else -1.5
            elif head.isdigit():
                s += 1.5
            if not head.isalnum() and c not in "“„«「\"(（":
                s -= 4.0
        if nesting:
            reach = nesting.reaches(e - 1)
            if reach > e - 1 or reach == e - 1 and e - 1 not in pairs:
                s -= 9.0  # within a quotation or bracket
        out.append(_Cut(e, nxt, s, quote, bracket if lower else -1))

    if _THAI.search(block):
        taken = {x.next for x in out}
        for m in re.finditer(r"\s+", block):
            a, b = start + m.start(), start + m.end()
            if a <= start or b >= end or b in taken:
                continue
            p, n = text[a - 1], text[b]
            edge = lambda ch: ch.isdigit() or (ch.isalpha() and unicodedata.name(ch, "").startswith("LATIN"))
            if (_is_thai(p) or _is_thai(n)) and not edge(p) and not edge(n) and p not in "([“\"«" and n not in ")]”»":
                out.append(_Cut(a, b, 4.0 - (9.0 if nesting and nesting.reaches(a) >= a else 0.0)))
        out.sort(key=lambda x: x.end)
    return out


def _span(text: str, a: int, cut: _Cut) -> float:
    """What a cut gains or loses by where its span began."""
    s = 0.0
    if cut.quote >= 0:
        lead = _last_word(text, a, cut.quote)
        if lead <= a:
            s -= 0.0 if text[cut.next] in "“„«「\"" or text[cut.next].isupper() else 4.0  # the quotation opens the span: its speaker follows
        elif text[lead - 1] in ":：":
            s += 2.5 if not text[cut.next].islower() else 0.0
    if cut.bracket > a and _last_word(text, a, cut.bracket) > a:
        s -= 5.0  # a remark within a sentence
    if cut.end - a <= _SHORT:
        body = text[a : cut.end]
        n = len(_WORD.findall(body))
        if n <= 1 and (body.rstrip().endswith("…") or body.endswith("..")):
            s -= 6.0 if not (_is_cjk(body[0]) and len(body) > 4) else 0.0
        elif n == 0:
            s -= 6.0
    return s


def _last_word(text: str, start: int, at: int) -> int:
    """The place behind the last character before ``at`` that is not blank."""
    while at > start and text[at - 1].isspace():
        at -= 1
    return at


def _best(text: str, begins: list[int], cuts: list[_Cut]) -> tuple[list[float], list[int]]:
    """Best score of a division that ends at each cut (0: the start of the block) and the cut before it."""
    best, back = [0.0] + [-math.inf] * len(cuts), [0] * (len(cuts) + 1)
    first = [0] * (len(cuts) + 1)  # where the running best of all starts so far stands
    for j, cut in enumerate(cuts, 1):
        far = bisect_left(begins, cut.end - _SHORT, 0, j)  # spans from these are longer than _SHORT
        marks = {_last_word(text, begins[0], q) for q in (cut.quote, cut.bracket) if q >= 0}
        edges = [0, *sorted(k for k in (bisect_left(begins, m, 0, far) for m in marks) if 0 < k < far), far]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                i = first[b - 1] if a == 0 else max(range(a, b), key=best.__getitem__)
                v = best[i] + cut.score + _span(text, begins[i], cut)
                if v > best[j]:
                    best[j], back[j] = v, i
        for i in range(far, j):
            if begins[i] < cut.end:
                v = best[i] + cut.score + _span(text, begins[i], cut)
                if v > best[j]:
                    best[j], back[j] = v, i
        first[j] = j if best[j] > best[first[j - 1]] else first[j - 1]
    return best, back


def spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """``start, end`` of every unit of a text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for start, end, item in blocks(text):
        while start < end and (text[start].isspace() or text[start] == "﻿"):
            start += 1
        while end > start and (text[end - 1].isspace() or text[end - 1] == "﻿"):
            end -= 1
        if start >= end:
            continue
        cuts = [] if item else _cuts(text, start, end, model)
        if not cuts:
            out.append((start, end))
            continue
        begins = [start] + [c.next for c in cuts]
        if all(c.quote < 0 and c.bracket < 0 and c.end - a > _SHORT for c, a in zip(cuts, begins)):
            ends = [k for k in range(len(cuts), 0, -1) if cuts[k - 1].score > 0]  # no cut depends on where its span began
        else:
            best, back = _best(text, begins, cuts)
            j = max(range(len(best)), key=best.__getitem__)
            ends = []
            while j:
                ends.append(j)
                j = back[j]
        at = start
        for k in reversed(ends):
            out.append((at, cuts[k - 1].end))
            at = cuts[k - 1].next
        out.append((at, end))
    return [(a, b) for a, b in out if text[a:b].strip(" \t\r\n﻿　\xa0")]


class Tally:
    """Counts of a batch: words are counted as they stand, and every distinct one is cleaned once."""

    def __init__(self) -> None:
        self.start: Counter[str] = Counter()
        self.inside: Counter[str] = Counter()
        self.before: Counter[str] = Counter()  # every token but the last
        self.last: Counter[str] = Counter()

    def add(self, text: str) -> None:
        for start, end, item in blocks(text):
            m = (_BULLET.match(text, start, end) or _NUMBER.match(text, start, end)) if item else None
            at = m.end() if m else start
            tokens = text[at:end].split()
            if not tokens:
                continue
            while text[at].isspace():
                at += 1
            key = _opening(text, at, end)
            if key:
                self.start[key] += 1
            self.inside.update(tokens[1:])
            self.last[tokens.pop()] += 1
            self.before.update(tokens)

    def counts(self) -> Counter[str]:
        """Counts by the kind of the word (s, i, t, f) and the cleaned word."""
        c: Counter[str] = Counter({"s" + k: n for k, n in self.start.items()})
        for t, n in self.inside.items():
            if t[0].isalpha() and not _is_cjk(t[0]):
                c["i" + _clean(t.strip("\"'“”„«»()[].,;:!?…"))] += n
            elif t[0].isdigit():
                c["i0"] += n
        for kind, tokens in (("t", self.before), ("f", self.last)):
            for t, n in tokens.items():
                if len(t) > 1 and t[-1] == "." and t[-2] != ".":
                    c[kind + _DIGITS.sub("0", _clean(t[:-1].lstrip("([\"“„«")))] += n
        return c

    def batch(self) -> pa.RecordBatch:
        c = self.counts()
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()), pa.array(list(c.values()), type=pa.int64())], ["w", "n"])


def learn(documents: DataFrame, size: int = MODEL_WORDS) -> Model:
    """The counts of all documents; the commonest ``size`` words reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    tally.add(text)
                    held += len(text)
            if held > _HELD:  # several batches share the cleaning of their words
                yield tally.batch()
                tally, held = Tally(), 0
        yield tally.batch()

    counted = documents.select("text").mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "w").limit(size).collect()
    part = lambda k: {r["w"][1:]: r["n"] for r in rows if r["w"][0] == k}
    return Model(part("s"), part("i"), part("f"), part("t"))


def split(documents: DataFrame) -> DataFrame:
    """``doc_id, start_char, end_char``: the units of every document."""
    model = learn(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t, model) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.array([x for f in found for span in f for x in span], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(flat[::2]), pa.array(flat[1::2])], ["doc_id", "start_char", "end_char"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start_char int, end_char int")
