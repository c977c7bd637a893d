"""Token ids of every document through a minimal acyclic transducer lexicon.

The tokenizer's vocabulary is read, never trained.  Its text splitter cuts a
document into words; ids of a word do not depend on its neighbours, so:

1. words are counted over the whole corpus (map-side combined) and the commonest
   ``size`` ones are taken (a top-k, bounded by that parameter);
2. they are encoded exactly and compiled into a minimal acyclic automaton with
   shared suffixes.  Every arc carries the number of words left of it, so the
   sum along a path is the word's rank, the index of its ids: a transducer from
   bytes to ids of constant output cost;
3. the automaton is one flat file, sent once per executor by Spark's file
   distribution and memory-mapped by all workers of that executor;
4. documents are encoded in Arrow batches: the distinct words of a batch walk
   the automaton together (vectorised, one step per byte); words it lacks are
   merged exactly by rank.

Defined results: null and empty texts give an empty list; special-token strings
in a text are ordinary text; repeats give the same ids again.
"""

from __future__ import annotations

import base64
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public text splitter of this family of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same splitter for texts in which only ASCII characters stand.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
LEXICON_WORDS = 50_000


class Merger:
    """Exact ids of one word by the ranks of a public vocabulary."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._any, self._ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def split(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def ids(self, word: str) -> list[int]:
        return self.enc._encode_single_piece(word)


def compile_lexicon(words: dict[str, list[int]], path: str) -> None:
    """Write the minimal automaton of ``words`` (incremental construction over sorted bytes) and their ids.

    File: int64 header [arcs, words, ids], arcs sorted by ``state*256+byte``
    (keys, targets, ranks), final flags by state, offsets and ids by rank.
    """
    keys = sorted((w.encode(), w) for w in words if w)
    register: dict[tuple, int] = {}
    states: list[tuple[dict[int, int], bool]] = []  # frozen states: arcs, final
    counts: list[int] = []
    path_: list[list] = [[{}, False]]  # states on the path of the last word: arcs to frozen states, final
    labels: list[int] = []

    def freeze(arcs: dict[int, int], final: bool) -> int:
        sig = (final, tuple(arcs.items()))
        if sig not in register:
            register[sig] = len(states)
            states.append((arcs, final))
            counts.append(int(final) + sum(counts[t] for t in arcs.values()))
        return register[sig]

    def cut(depth: int) -> None:
        while len(path_) - 1 > depth:
            arcs, final = path_.pop()
            path_[-1][0][labels.pop()] = freeze(arcs, final)

    last = b""
    for key, _ in keys:
        common = len(os.path.commonprefix((last, key)))
        cut(common)
        for b in key[common:]:
            labels.append(b)
            path_.append([{}, False])
        path_[-1][1] = True
        last = key
    cut(0)
    root = freeze(*path_[0])

    arc_key, arc_to, arc_rank = [], [], []
    for s, (arcs, final) in enumerate(states):
        before = int(final)
        for b in sorted(arcs):
            arc_key.append(s * 256 + b)
            arc_to.append(arcs[b])
            arc_rank.append(before)
            before += counts[arcs[b]]
    order = np.argsort(np.array(arc_key, dtype=np.int64), kind="stable")
    lists = [words[w] for _, w in keys]
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    with open(path, "wb") as f:
        np.array([len(arc_key), len(states), len(lists), offsets[-1], root], dtype=np.int64).tofile(f)
        for a in (arc_key, arc_to, arc_rank):
            np.array(a, dtype=np.int64)[order].tofile(f)
        np.array([final for _, final in states], dtype=np.int64).tofile(f)
        offsets.tofile(f)
        np.array([i for x in lists for i in x], dtype=np.int64).tofile(f)


class Lexicon:
    """The compiled automaton, memory-mapped: workers of a machine share its pages."""

    def __init__(self, path: str) -> None:
        m = np.memmap(path, dtype=np.int64, mode="r")
        arcs, states, n, ids, self.root = (int(x) for x in m[:5])
        at = 5
        self.parts = []
        for size in (arcs, arcs, arcs, states, n + 1, ids):
            self.parts.append(m[at : at + size])
            at += size
        self.key, self.to, self.rank, self.final, self.offset, self.ids = self.parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where the lexicon lacks it; all words walk one byte a step."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.key):
            return out
        length = np.fromiter((len(w) for w in words), dtype=np.int64, count=n)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        alive = np.flatnonzero(length > 0)
        state, rank = np.full(n, self.root, dtype=np.int64), np.zeros(n, dtype=np.int64)
        step = 0
        while len(alive):
            want = state[alive] * 256 + flat[start[alive] + step]
            at = np.searchsorted(self.key, want)
            at[at == len(self.key)] = 0
            ok = self.key[at] == want
            alive, at = alive[ok], at[ok]
            state[alive], step = self.to[at], step + 1
            rank[alive] += self.rank[at]
            done = length[alive] == step
            ends = alive[done]
            ends = ends[self.final[state[ends]] == 1]
            out[ends] = rank[ends]
            alive = alive[~done]
        return out


def word_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``word, n`` over the whole corpus, combined per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Merger(tokenizer).split
        for batch in batches:
            c: Counter[str] = Counter()
            for text in batch["text"]:
                if text:
                    c.update(split(text))
            if c:
                yield pd.DataFrame({"word": list(c.keys()), "n": list(c.values())})

    counted = documents.select("text").mapInPandas(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build(documents: DataFrame, tokenizer: str = TOKENIZER, size: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of the commonest words and hand it to the executors; returns its file name."""
    rows = word_counts(documents, tokenizer).orderBy(F.desc("n"), "word").limit(size).select("word").collect()
    merge = Merger(tokenizer)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-lexicon-"), name)  # on the driver; executors fetch it through Spark
    compile_lexicon({r["word"]: merge.ids(r["word"]) for r in rows}, path)
    documents.sparkSession.sparkContext.addFile(path)
    return name


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + size]`` one after the other."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)] if total else flat[:0]


def encode(documents: DataFrame, tokenizer: str = TOKENIZER, size: int = LEXICON_WORDS, key: str = "doc_id") -> DataFrame:
    """``key, ids`` of every document."""
    name = build(documents, tokenizer, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, lexicon = Merger(tokenizer), Lexicon(SparkFiles.get(name))
        for batch in batches:
            code_of: dict[str, int] = {}
            pieces = [merge.split(t) if t else [] for t in batch.column(1).to_pylist()]
            codes = np.array([code_of.setdefault(w, len(code_of)) for p in pieces for w in p], dtype=np.int64)
            words = list(code_of)
            ranks = lexicon.ranks([w.encode() for w in words])
            merged = [merge.ids(words[i]) for i in np.flatnonzero(ranks < 0)]  # the words the lexicon lacks
            known = ranks >= 0
            count = np.zeros(len(words), dtype=np.int64)
            count[known] = lexicon.offset[ranks[known] + 1] - lexicon.offset[ranks[known]]
            count[~known] = [len(m) for m in merged]
            start = np.zeros(len(words), dtype=np.int64)
            start[known] = lexicon.offset[ranks[known]]
            start[~known] = len(lexicon.ids) + np.concatenate(([0], np.cumsum(count[~known])))[:-1]
            table = np.concatenate([lexicon.ids, np.array([i for m in merged for i in m], dtype=np.int64)])
            ids = _gather(table, start[codes], count[codes])
            upto = np.concatenate(([0], np.cumsum(count[codes])))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    return documents.select(key, "text").mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, ids array<int>")


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", keep: tuple[str, ...] = (), held: int = 1 << 18) -> DataFrame:
    """``key, n_tokens`` of every document in one pass; the columns of ``keep`` are carried along.

    Each worker remembers the sizes of up to ``held`` words and starts anew beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merger(tokenizer)
        size_of: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n = 0
                for w in merge.split(text) if text else ():
                    k = size_of.get(w)
                    if k is None:
                        k = size_of[w] = len(merge.ids(w))
                    n += k
                out.append(n)
                if len(size_of) > held:
                    size_of.clear()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(out, type=pa.int64())], [key, *keep, "n_tokens"])

    kinds = ", ".join(f"{k} {documents.schema[k].dataType.simpleString()}" for k in (key, *keep))
    return documents.select(key, *keep, "text").mapInArrow(run, f"{kinds}, n_tokens bigint")
