"""Defective question-answer pairs by noisy labelling functions and an EM label model.

Every question of a conversation is paired with the element that follows it.
Labelling functions vote for or against each defect, each from evidence of its
own: no function of a defect fires only where another one does.  Per defect, an
expectation-maximisation label model (``labelmodel``) weighs them by how they agree
over all pairs, and a label is kept above a cutoff that was validated on
labelled pairs: one half (by hash) of all sound pairs of the table and the same
pairs with one defect put in.  The other half anchors the fit, with the weight of
``ANCHOR`` pairs, so that the defects put in do not outweigh those found.  A pair may keep several labels (``labels``);
``found`` reports the first kept one in the order of ``DEFECTS``, in which a defect
stands before those it brings along (a copied question has no end mark either).

The language of a text is told by its script and by character trigrams
(``langid``), fitted on all labelled documents and all turns.

Votes are taken per row before repeats are removed, so the shuffle carries a few
bytes a pair and never a text; the label model sees the counts of vote patterns
only, at most 3^5 per defect.

Defined results: null or empty conversations have no question; a missing answer
is ``empty``; repeats of a conversation count once; without labelled documents
only the script tells languages apart.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import labelmodel, langid
from millrace.llm.langid import Languages
from millrace.llm.text import plain
from millrace.runtime import materialize

ANCHOR = 400  # pairs that all the labelled ones together count as in the fit
DEFECTS = ("empty", "copy", "refusal", "truncated", "other_language")
_TAG = re.compile(r"<\|[^<>|]*\|>|</?[A-Za-z][^<>]*>")
_TAG_HEAD = re.compile(r"<(?:\|[^<>\s]*|/?[A-Za-z][^<>]*|/)?\Z")  # a tag that is not closed up to the end
_FENCE = re.compile(r"```(?:\w+)?")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LETTER = re.compile(r"[^\W_]")
_SCRIPTS = (re.compile("[а-яё]"), re.compile("[\u3040-\u30ff]"), re.compile("[\u3400-\u9fff]"), re.compile(r"[^\W\d_]"))
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」|『[^』]*』")
_LEAD, _LEAD_EACH = 5.0, 0.2  # how much likelier the best language must be, in all and for every trigram
_END = ".!?…。！？।؟"
_AFTER_END = "\"'”’»」』)）]】`*_ \t\r\n"
#: Words that stand for no answer.
PLACEHOLDERS = frozenset(
    "n/a na n.a nil null none nan undefined tbd todo empty blank nothing unknown missing void no_answer noanswer placeholder pending "
    "keine leer nichts ninguno nada vacío aucun aucune rien vide нет пусто ничего 无 空 空白 なし 空欄 該当なし".split()
) | {"no answer", "not available", "not applicable", "no response", "no data", "no content", "[empty]", "lorem ipsum"}
#: Words after which no sentence ends.
_DANGLING = frozenset(
    "the a an of and or with to in on at by for from as while because since before after but near that which is was has are were very "
    "der die das ein eine einem einen und oder mit von zu im am auf an bei nach vor trotz ohne weil dass dem den des "
    "le la les un une et ou de du des à au aux sur dans avec sans car que devant après "
    "el los las una y o del en con sin por para porque al después pesar "
    "и или в на с у к по от до из без перед после потому что".split()
)
_NAMED = {
    "en": r"\benglish\b|\benglisch|\banglais|\bingl[eé]s|английск|英语|英文|英語",
    "de": r"\bgerman\b|\bdeutsch|\ballemand|\balem[aá]n|немецк|德语|德文|ドイツ語",
    "fr": r"\bfrench\b|franz[oö]sisch|\bfran[cç]ais|\bfranc[eé]s|французск|法语|法文|フランス語",
    "es": r"\bspanish\b|\bspanisch|\bespagnol|\bespa[nñ]ol|испанск|西班牙|スペイン語",
    "ru": r"\brussian\b|\brussisch|\brusse\b|\bruso\b|русск|俄语|俄文|ロシア語",
    "zh": r"\bchinese\b|\bchinesisch|\bchinois|\bchino\b|китайск|中文|汉语|漢語|中国語",
    "ja": r"\bjapanese\b|\bjapanisch|\bjaponais|\bjapon[eé]s|японск|日语|日文|日本語",
}
_NAMED = {k: re.compile(v, re.I) for k, v in _NAMED.items()}

#: Words without one of which no pattern below can match (a plain lookup spares most searches).
_MAY_REFUSE = frozenset("i we beyond allow me ich mir nicht je ne impossible no debo tengo prefiero я мне мы могу отказываюсь".split())
_MAY_ASK = frozenset(
    "request question guidelines instructions policy policies programming rules ai assistant language appropriate answer images attached possible identifying objects "
    "anfrage auskunft dabei demande image pregunta eso ответа этим этот эту".split()
)
_COUNTING = re.compile(r"how many|wie viele|combien|cuánt|сколько|多少|几|いくつ", re.I)
_UNABLE = re.compile(
    r"\b(?:i|we)(?:['’]m| am| are)?\b[^.!?]{0,30}?(?:\bcan['’]?t\b|\bcannot\b|\bcan not\b|\bunable\b|\bnot able\b|\bwon['’]t\b|\bwill not\b|\bnot (?:permitted|allowed|comfortable|going)\b|"
    r"\bdeclin|\brefus|\bprefer not\b|\brather not\b|\bmust pass\b|\bdo not (?:have|comment|label|assess|segment|talk|discuss|describe|answer|provide|feel)\b|\bdon['’]t (?:have|comment|answer|do)\b|\bhave to pass\b)"
    r"|\bi['’]d (?:prefer|rather) not\b|\bi have to decline\b|\bnot be (?:appropriate|able|possible) for me\b|\bdo(?:es)? not allow me\b|\bbeyond (?:my|what i)\b"
    r"|\bich\b[^.!?]{0,40}\b(?:nicht|ablehnen|keine|weigere|verweiger)|\b(?:muss|darf|kann|möchte|werde) ich\b[^.!?]{0,40}\b(?:nicht|ablehnen|keine|leider)|\bmir (?:ist es |leider )?nicht\b|\bnicht (?:helfen|beantworten)\b"
    r"|\bje (?:ne|n['’]|refuse|décline|dois|suis|me vois)\b[^.!?]{0,40}(?:\bpas\b|refus|déclin|désolé|autoris|dans l['’]incapacité)|\bje (?:refuse|décline|regrette)\b|\bne (?:m['’]est|suis) pas\b|\bimpossible (?:pour moi|de répondre)\b"
    r"|\bno (?:puedo|voy a|debo|me (?:es|está|siento)|estoy|soy capaz|tengo (?:permi|la capac))|\bme (?:niego|veo obligad)|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)|\bprefiero no\b"
    r"|(?:\bя\b|\bмне\b|\bмы\b)[^.!?]{0,40}(?:не могу|не буду|не имею|не разреш|не позвол|нельзя|вынужден|отказ|не в состоянии|не умею)|не могу (?:помочь|ответить|выполнить)|отказываюсь"
    r"|我(?:无法|不能|不会|不可以|没有办法|没法|不便|拒绝|不得不拒绝|必须拒绝|不被允许)|无法(?:回答|提供|协助|帮助|处理|满足)|不能(?:回答|提供|协助|帮助)|拒绝回答|恕(?:我|难)"
    r"|(?:お答え|回答|お手伝い|対応|お応え|ご案内|説明|お話し?)(?:する)?(?:こと)?(?:は|が|を)?(?:でき(?:ません|かねます)|いたしかねます|致しかねます|控え|差し控え|お断り)|できかねます|お断り|ご遠慮",
    re.I,
)
_POLICY = re.compile(
    r"\bmy (?:guidelines|instructions|policy|policies|programming|rules)\b|\bas an? (?:ai|assistant|language model)\b|\bappropriate for me\b|\bthat request\b|\bthis request\b|\bthis question\b|\banswer this\b|"
    r"\bview images\b|\bprocess the attached\b|\bno answer is possible\b|\bidentifying objects\b|\bdiese anfrage\b|\bauskunft\b|\bdabei\b[^.]*helfen|\bcette (?:demande|question|image)\b|\besta pregunta\b|\bcon eso\b|"
    r"от ответа|с этим|эт(?:от|у) (?:вопрос|запрос|просьб)|这个(?:问题|请求)|您的(?:问题|请求)|この(?:質問|ご?依頼|画像)|ご要望",
    re.I,
)
_APOLOGY = re.compile(
    r"^\W*(?:sorry|i['’]?m sorry|i am sorry|apologies|i apologi[sz]e|unfortunately|regrettably|thanks for asking|es tut mir leid|leider|entschuldigung|tut mir leid|désolée?|je suis désolé|malheureusement|"
    r"lo siento|lamentablemente|disculp|perdón|извините|простите|к сожалению|抱歉|很抱歉|对不起|不好意思|申し訳|すみません|恐れ入り|残念)",
    re.I,
)
_OFFER = re.compile(r"consult a specialist|ask something else|anything else|something else i can|try (?:another|a different) (?:question|image)", re.I)
_ADVERSE = re.compile(r"\b(?:but|however|though|yet|aber|doch|jedoch|mais|cependant|pero|sin embargo|но|однако)\b|但|不过|しかし|ですが", re.I)
_FIRST_PERSON = frozenset("i we ich wir je nous yo nosotros я мы".split())


def goes_on(text: str) -> bool:
    """Whether a text that says what it cannot do goes on, after a word of contrast, with a statement that is not about itself."""
    m = _UNABLE.search(text)
    turn = _ADVERSE.search(text, m.end()) if m else None
    if not turn:
        return False
    rest = text[turn.end() :]
    words = _units(rest)
    return len(words) >= 4 and not any(w.partition("'")[0].partition("’")[0] in _FIRST_PERSON for w in words) and not any(r.search(rest) for r in (_UNABLE, _POLICY, _OFFER))


@lru_cache(maxsize=64)  # an answer is looked at by several functions in turn
def _bare(text: str) -> str:
    """Text without markup: no fences, tags, mask tokens."""
    if "`" in text:
        text = _FENCE.sub(" ", text)
    return _TAG.sub(" ", text) if "<" in text else text


def _content(text: str) -> bool:
    """Whether there is a letter or digit outside the markup."""
    return bool(_LETTER.search(_bare(text)))


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


def _units(text: str) -> list[str]:
    """Words; pairs of characters where the script has no blanks."""
    body = _bare(text)
    words = _WORD.findall((body.lower() if body.isascii() else plain(body)).replace("_", " "))
    if body.isascii():
        return words
    out: list[str] = []
    for w in words:
        out += [w[i : i + 2] for i in range(max(1, len(w) - 1))] if _cjk(w[0]) else [w]
    return out


def prose(text: str) -> str:
    """A text without markup and quotations."""
    body = _bare(text)
    return body if body.isascii() and '"' not in body else _QUOTED.sub(" ", body)


@lru_cache(maxsize=1 << 14)
def script(body: str) -> str | None:
    """The script of a prose: latin, ru, ja, zh or another one's first letter; None without letters."""
    if body.isascii():
        return "latin" if _SCRIPTS[3].search(body) else None
    low = body.lower()
    cyr, kana, han, letters = (len(r.findall(low)) for r in _SCRIPTS)
    if not letters:
        return None
    cjk = 2 * (kana + han)  # a character of these scripts says as much as two letters
    rest = letters - cyr - kana - han
    if cyr > rest and cyr > cjk:
        return "ru"
    if cjk > rest:
        return "ja" if kana * 5 > han else "zh"
    odd = [c for c in low if c.isalpha() and "\u0590" <= c < "\u1100"]  # Hebrew to Georgian
    return unicodedata.name(odd[0], "x").split()[0] if 2 * len(odd) > rest else "latin"


def tell_languages(texts: list[str | None], languages: Languages) -> list[str | None]:
    """The language of each prose, None where the trigrams do not tell."""
    distinct = list(dict.fromkeys(t for t in texts if t))
    if not distinct or not languages.names:
        return [None] * len(texts)
    scores, size = languages.scores(distinct)
    best = scores.argmax(axis=1)
    top = scores[np.arange(len(best)), best]
    scores[np.arange(len(best)), best] = -np.inf
    lead = top - scores.max(axis=1) if scores.shape[1] > 1 else np.full(len(best), np.inf)
    sure = lead > np.maximum(_LEAD, _LEAD_EACH * size)
    name = {t: languages.names[b] if ok else None for t, b, ok in zip(distinct, best, sure, strict=True)}
    return [name.get(t) for t in texts]


def _parsed(answer: str):
    """(looks like a structure, value or None)."""
    body = _FENCE.sub("", answer).strip()
    if "```" not in answer and body[:1] not in ("[", "{"):
        return False, None
    if not body:
        return True, []
    try:
        return True, json.loads(body, strict=False)
    except ValueError:
        return True, None


def _hollow(v) -> bool:
    if isinstance(v, dict):
        return all(_hollow(x) for x in v.values())
    if isinstance(v, list):
        return all(_hollow(x) for x in v)
    return v is None or (isinstance(v, str) and not _content(v))


@lru_cache(maxsize=1 << 14)
def _wanted(q: str) -> list[str]:
    """Languages a question names."""
    return [k for k, r in _NAMED.items() if r.search(q)]


@lru_cache(maxsize=1 << 14)
def _units_of_question(q: str) -> list[str]:
    return _units(q)


@lru_cache(maxsize=1 << 14)
def _last_question(q: str) -> list[str]:
    parts = [p for p in re.split(r"(?<=[.!?。！？])\s*(?=\S)", _bare(q).strip()) if _content(p)]
    return _units(parts[-1]) if parts else []


def votes(question: str | None, answer: str | None, wq: str | None = None, wa: str | None = None, pq: str | None = None, pa: str | None = None) -> dict[str, tuple[int, ...]]:
    """The votes of every labelling function on one pair; ``answer`` is None where it is missing, ``wq`` and ``wa`` the languages the trigrams tell, ``pq`` and ``pa`` the proses."""
    q = question or ""
    a = answer or ""
    content = _content(a)
    odd = "" if a.isascii() else "".join(c for c in set(a) if unicodedata.category(c) in ("So", "Sk", "Cf"))
    stripped = a.strip().rstrip(odd + " \t\r\n")
    ua, uq = _units(a), _units_of_question(q)
    structure, value = _parsed(a)

    # empty
    word = plain(_bare(a)).strip().strip(".!?。[]()<>\"'`*_- ")
    target = word == "no target" or word == "none" and bool(_COUNTING.search(q))
    holder = word in PLACEHOLDERS and not target
    hollow = structure and value is not None and _hollow(value)
    empty = (
        1 if answer is None else 0,
        1 if answer is not None and not content and not hollow else 0 if holder or hollow or answer is None else -1,
        1 if holder else 0,
        1 if hollow else 0,
        -1 if len(ua) >= 3 and not hollow else 0,
    )
    # copy
    said = [u for u in ua if u not in ("q", "question")] if ua[:1] in (["q"], ["question"]) else ua
    asked, core = set(uq), _last_question(q)
    same = bool(said) and ("".join(said) == "".join(uq) or "".join(said) == "".join(core) or "".join(said) == "".join(uq) * 2 or "".join(said) == "".join(core) * 2)
    known = sum(u in asked for u in said) / len(said) if said else 0.0
    covers = sum(u in set(said) for u in core) / len(core) if core else 0.0
    fuzzy = len(said) >= 2 and known >= 0.94 and covers >= 0.7 and not structure
    close = len(said) >= 4 and not structure and known >= 0.8 and covers >= 0.8 and len(said) <= len(uq)
    copy = (1 if same else 0, 1 if fuzzy and not same else 0, 1 if close and not fuzzy and not same else 0, -1 if known < 0.6 or structure else 0, -1 if known < 0.94 and not same else 0)

    # refusal
    said_in = prose(a) if pa is None else pa
    speaks = not structure and len(ua) >= 3
    heads = {w.partition("'")[0].partition("’")[0] for w in ua} if speaks else set()
    cjk = speaks and any(_cjk(u[0]) for u in ua)
    unable = speaks and (cjk or not heads.isdisjoint(_MAY_REFUSE)) and bool(_UNABLE.search(said_in))
    policy = speaks and (cjk or not heads.isdisjoint(_MAY_ASK) or "просьб" in said_in.lower() or "запрос" in said_in.lower()) and bool(_POLICY.search(said_in))
    sorry = speaks and bool(_APOLOGY.search(said_in))
    offer = speaks and ("else" in heads or "specialist" in heads or "another" in heads or "different" in heads) and bool(_OFFER.search(said_in))
    refusal = (
        1 if unable else 0,
        1 if policy and (unable or sorry) else 0,
        1 if sorry else 0,
        1 if offer else 0,
        -1 if structure or not (unable or sorry or policy) or unable and goes_on(said_in) else 0,
    )

    # truncated
    tail = stripped.rstrip(_AFTER_END.replace("`", "")) or stripped
    ended = stripped.rstrip(_AFTER_END)[-1:] in tuple(_END) if stripped.rstrip(_AFTER_END) else False
    sentence = not structure and (len(ua) >= 2 if not (ua and _cjk(ua[0][0])) else len(ua) >= 3)
    open_tag = a.rfind("<")
    cut_tag = open_tag > a.rfind(">") and bool(_TAG_HEAD.match(a, open_tag)) or a.count("<p>") > a.count("</p>") or a.count("<|mt_start|>") != a.count("<|mt_end|>")
    cut_fence = a.count("```") % 2 == 1
    last = ua[-1] if ua else ""
    truncated = (
        1 if sentence and not ended else -1,
        1 if cut_tag or cut_fence else 0,
        1 if structure and value is None else -1 if structure else 0,
        1 if content and not ended and not structure and (last in _DANGLING or tail[-1:] in ",;:-，、：；") else 0,
        -1 if ended and not cut_tag or structure and value is not None else 0,
    )

    # other language
    sq, sa = script(prose(q) if pq is None else pq), script(said_in)
    full = not structure and (len(ua) >= 3)
    wanted = _wanted(q)
    la = wa or (sa if sa != "latin" else None)
    lq = wq or (sq if sq != "latin" else None)
    granted = bool(wanted) and (la in wanted or la is None)
    apart = full and sa is not None and sq is not None and sa != sq
    other = (
        1 if apart and not granted else 0,
        1 if full and not apart and la is not None and lq is not None and la != lq and not granted else 0,
        1 if full and not apart and wanted and wa is not None and wa not in wanted and wa != lq else 0,
        -1 if granted or not full else 0,
        -1 if la is not None and la == lq else 0,
    )
    return {"empty": empty, "copy": copy, "refusal": refusal, "truncated": truncated, "other_language": other}


_SIGN = {-1: "-", 0: "0", 1: "+"}


def _signs(v: dict[str, tuple[int, ...]]) -> list[str]:
    return ["".join(_SIGN[x] for x in v[d]) for d in DEFECTS]


def _patterns(questions: list[str | None], answers: list[str | None], numbers: list[int], languages: Languages, memo: dict) -> tuple[list[list[str]], list[list[str]]]:
    """The vote patterns of a batch of pairs, one text per defect, and those of the labelled pairs made of each sound one."""
    body = [None if t is None else prose(t) for t in (*questions, *answers)]
    told = tell_languages(body, languages)
    many = len(questions)
    out = [_signs(votes(q, a, told[n], told[many + n], body[n], body[many + n])) for n, (q, a) in enumerate(zip(questions, answers, strict=True))]
    sound = [n for n in range(many) if questions[n] and answers[n] and not any("+" in x for x in out[n])]
    return out, _labelled(sound, questions, answers, numbers, body, told, out, languages, memo)


def _labelled(sound: list[int], questions: list, answers: list, numbers: list[int], body: list, told: list, patterns: list[list[str]], languages: Languages, memo: dict) -> list[list[str]]:
    """For every pair of a batch the labelled ones made of it, as half, defect put in (``_SOUND``: none) and vote patterns; only sound pairs have some."""
    many = len(questions)
    made: list[list[str]] = [[] for _ in range(many)]
    tongue = {n: told[n] or (script(body[n]) if script(body[n]) != "latin" else None) for n in sound}
    whole = [n for n in sound if not _parsed(answers[n])[0]]
    spoken: dict[str, list[int]] = {}  # full answers by the language of their questions
    for n in whole:
        if tongue[n] and len(_units(answers[n])) >= 4:
            spoken.setdefault(tongue[n], []).append(n)
    cut = {n: " ".join(w[: len(w) * 2 // 3]).rstrip(_END + _AFTER_END + ",;:") for n in whole if len(w := answers[n].split(" ")) > 4}
    cut_body = [prose(a) for a in cut.values()]
    cut_told = dict(zip(cut, zip(tell_languages(cut_body, languages), cut_body, strict=True), strict=True))
    others = {t: [u for u in sorted(spoken) if u != t] for t in {*tongue.values()} if t}
    refusals = dict(zip(_REFUSALS, tell_languages(list(_REFUSALS.values()), languages), strict=True))

    def voted(n: int, a: str | None, wa: str | None) -> list[str]:
        """Votes on an answer that is made of the question alone; questions come again and again."""
        key = questions[n], a
        if key not in memo:
            if len(memo) > 1 << 15:
                memo.clear()
            memo[key] = _signs(votes(questions[n], a, told[n], wa, body[n]))
        return memo[key]

    for n in sound:
        q, half, k = questions[n], numbers[n] & 1, numbers[n] >> 1
        put = lambda d, p: made[n].append(f"{half}{d}{''.join(p)}")  # noqa: B023, E731
        put(_SOUND, patterns[n])
        put(DEFECTS.index("empty"), voted(n, (None, "", " ", "...", "<p></p>", "[]")[k % 6], None))
        put(DEFECTS.index("copy"), voted(n, (q, q.upper(), f'Q: "{q}"')[k % 3], told[n]))
        if tongue[n] in _REFUSALS:
            put(DEFECTS.index("refusal"), voted(n, _REFUSALS[tongue[n]], refusals[tongue[n]]))
        if n in cut:
            put(DEFECTS.index("truncated"), _signs(votes(q, cut[n], told[n], cut_told[n][0], body[n], cut_told[n][1])))
        if tongue[n] and others[tongue[n]]:
            there = spoken[others[tongue[n]][k % len(others[tongue[n]])]]  # every other language in turn
            m = there[k // 7 % len(there)]
            put(DEFECTS.index("other_language"), _signs(votes(q, answers[m], told[n], told[many + m], body[n], body[many + m])))
    return made


_SOUND = len(DEFECTS)


def _patterns_udf(languages: Languages):
    memo: dict = {}

    @F.pandas_udf("patterns array<string>, made array<string>")
    def udf(question: pd.Series, answer: pd.Series, number: pd.Series) -> pd.DataFrame:
        patterns, made = _patterns(list(question), list(answer), number.tolist(), languages, memo)
        return pd.DataFrame({"patterns": patterns, "made": made})

    return udf


def pairs(conversations: DataFrame) -> DataFrame:
    """``conv_id, ingested_at, turn, question, answer`` of every question; the answer is null where it is missing.

    Neighbours are paired inside the array, so a conversation is never copied to its turns.
    """
    asks = lambda m: F.coalesce(F.lower(F.trim(m["from"])).isin("human", "user"), F.lit(False))

    def turn(m: Column, i: Column) -> Column:
        after = F.get("conversations", i + 1)
        return F.struct(i.cast("int").alias("turn"), m["value"].alias("question"), F.when(~asks(after), after["value"]).alias("answer"), asks(m).alias("ask"))

    turns = F.filter(F.transform("conversations", turn), lambda t: t["ask"])
    return conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "ingested_at", F.inline(turns)).drop("ask")


def pair_votes(conversations: DataFrame, languages: Languages) -> DataFrame:
    """``conv_id, turn, patterns, made``: the votes on every pair and on the labelled ones made of it, repeats counted once."""
    number = F.pmod(F.xxhash64(F.lit(11), "conv_id", "turn"), F.lit(1 << 30))
    voted = pairs(conversations).select("conv_id", "turn", "ingested_at", _patterns_udf(languages)("question", "answer", number).alias("v"))
    newest = voted.groupBy("conv_id", "turn").agg(F.max(F.struct("ingested_at", "v")).alias("r"))
    return newest.select("conv_id", "turn", "r.v.patterns", "r.v.made")


#: Refusals put into sound pairs.
_REFUSALS = {
    "en": "I'm sorry, but I am not able to answer this question.", "de": "Das kann ich leider nicht beantworten.", "fr": "Je suis désolé, je ne peux pas répondre à cette question.",
    "es": "Lo siento, no puedo responder a esta pregunta.", "ru": "Извините, я не могу ответить на этот вопрос.", "zh": "抱歉，我无法回答这个问题。", "ja": "申し訳ありませんが、お答えできません。",
}


def _value(pattern: str) -> tuple[int, ...]:
    return tuple({"-": -1, "0": 0, "+": 1}[c] for c in pattern)


def posteriors(counts: list[dict[tuple[int, ...], int]], labelled: list[tuple[list, list]]) -> dict[tuple[int, str], tuple[float, float]]:
    """(defect number, pattern) -> (posterior, cutoff): fitted on the counts of all pairs and one half of the labelled ones, the cutoff on the other half."""
    out: dict[tuple[int, str], tuple[float, float]] = {}
    for d, counted in enumerate(counts):
        if not counted:
            continue
        model = labelmodel.fit(counted, labelled[d][0])
        bar = labelmodel.cutoff(model, labelled[d][1])
        for p in counted:
            out[d, "".join(_SIGN[v] for v in p)] = (model.posterior(p), bar)
    return out


def labelled_counts(voted: DataFrame) -> list[tuple[list, list]]:
    """Per defect the labelled vote patterns ``(votes, has the defect, weight)`` of one half and ``(.., number)`` of the other: at most 5 * 3^5 * 4 rows."""
    each = voted.select(F.explode("made").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(len(DEFECTS) - 1))))
    kind = F.substring("m", 2, 1).cast("int")
    pattern = F.col("m").substr(F.col("d") * 5 + 3, F.lit(5))
    rows = each.groupBy(F.substring("m", 1, 1).cast("int").alias("half"), "d", (kind == F.col("d")).alias("has"), pattern.alias("p")).agg(F.sum("n").alias("n"), F.sum(F.when(kind == _SOUND, F.col("n"))).alias("sound")).collect()
    sound = sum(r["sound"] or 0 for r in rows if r["d"] == 0)
    weight = min(1.0, ANCHOR / max(1, sound))
    halves = lambda d, half, w: [(_value(r["p"]), r["has"], r["n"] * w) for r in rows if r["d"] == d and r["half"] == half]
    return [(halves(d, 0, weight), halves(d, 1, 1)) for d in range(len(DEFECTS))]


def pattern_counts(voted: DataFrame) -> list[dict[tuple[int, ...], int]]:
    """Per defect the number of pairs of every vote pattern: at most 5 * 3^5 rows."""
    rows = voted.select(F.posexplode("patterns").alias("defect", "pattern")).groupBy("defect", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    return [{_value(r["pattern"]): r["n"] for r in rows if r["defect"] == d} for d in range(len(DEFECTS))]


def fitted_languages(conversations: DataFrame, documents: DataFrame) -> Languages:
    """The language model of the labelled documents, fitted on with the turns themselves."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.explode("conversations.value").alias("v")).where(F.col("v").isNotNull())
    return langid.adapt(langid.learn(documents), turns, prose)


def labels(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """``conv_id, turn, defect, posterior``: every label kept, several a pair where several pass their cutoffs."""
    languages = fitted_languages(conversations, documents)
    voted = materialize(pair_votes(conversations, languages), "p1-votes")
    counts, labelled = pattern_counts(voted), labelled_counts(voted)
    kept = [(d, p, float(post)) for (d, p), (post, bar) in posteriors(counts, labelled).items() if post >= bar]
    known = voted.sparkSession.createDataFrame(kept, "defect_no int, pattern string, posterior double")
    flat = voted.select("conv_id", "turn", F.posexplode("patterns").alias("defect_no", "pattern")).where(F.col("pattern").contains("+"))
    name = F.element_at(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect_no") + 1)
    # at most 5 * 3^5 rows
    return flat.join(F.broadcast(known), ["defect_no", "pattern"]).select("conv_id", "turn", name.alias("defect"), "posterior", "defect_no")


def found(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """``conv_id, turn, defect``: the first kept label of each defective pair."""
    best = F.min_by("defect", F.col("defect_no"))
    return labels(conversations, documents).groupBy("conv_id", "turn").agg(best.alias("defect"))


def report(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """Kept labels per defect."""
    return labels(conversations, documents).groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))
