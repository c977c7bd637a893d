"""Language of short texts by character trigrams, fitted on labelled documents.

A naive Bayes model over hashed trigrams of letters (word borders included).  It
is fitted on all labelled rows, counted where they are read, and is a table of
``BUCKETS`` rows of one number per language, whatever the size of the corpus.  Texts are scored by the batch, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
_SMOOTH = 0.5
_MUCH = 1 << 20  # characters scored at once
_OTHER = re.compile(r"(?:[^\w¿¡]|[\d_])+")  # what is no letter; the opening marks of a language count as letters


def label(lang: Column) -> Column:
    """The two letters of a language tag, however it is spelled."""
    two = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(two == "jp", "ja").otherwise(two)


def _buckets(text: str) -> np.ndarray:
    """Trigram buckets of the letters of a text."""
    body = _OTHER.sub(" ", text.lower()).strip()
    if not body:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f" {body} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


@dataclass(frozen=True)
class Languages:
    """``names`` and the log-probability of every bucket in every language."""

    names: tuple[str, ...]
    table: np.ndarray
    counts: np.ndarray | None = field(default=None, repr=False)  # kept by the driver to go on fitting

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of every text in every language, trigrams of every text)."""
        out, size = np.zeros((len(texts), len(self.names)), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
        held: list[np.ndarray] = []
        first = 0
        total = 0

        def settle(upto: int) -> None:
            if total:
                rows = np.repeat(np.arange(first, upto), size[first:upto])
                picked = self.table[np.concatenate(held)]
                starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                out[rows[starts]] = np.add.reduceat(picked, starts, axis=0)

        for n, t in enumerate(texts):
            b = _buckets(t)
            size[n] = len(b)
            held.append(b)
            total += len(b)
            if total > _MUCH:
                settle(n + 1)
                held, first, total = [], n + 1, 0
        settle(len(texts))
        return out, size


def _table(counts: np.ndarray) -> np.ndarray:
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _counted(df: DataFrame, told: Callable[[pa.RecordBatch], Iterator[tuple[str, str]]]) -> dict[str, np.ndarray]:
    """Trigrams per language of the ``(language, text)`` that ``told`` makes of every batch; one number per language and bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in told(batch):
                held.setdefault(lang, []).append(_buckets(text))
            for lang, each in held.items():
                now = np.bincount(np.concatenate(each), minlength=BUCKETS)
                seen[lang] = seen[lang] + now if lang in seen else now
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["l", "b", "n"])

    rows = df.mapInArrow(run, "l string, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    lang, at, n = np.array(rows.column("l").to_pylist(), dtype=object), rows.column("b").to_numpy(), rows.column("n").to_numpy()
    out = {}
    for name in sorted(set(lang)):
        mine = lang == name
        out[name] = np.zeros(BUCKETS)
        out[name][at[mine]] = n[mine]
    return out


def adapt(model: Languages, texts: DataFrame, prose: Callable[[str], str], lead: float = 12.0, each: float = 0.5) -> Languages:
    """The model fitted on, with those of a column of texts whose language it tells beyond doubt, so that it knows their words too.

    Returned without its counts: what travels to the workers is the table.
    """
    known = Languages(model.names, model.table)
    if model.counts is None or len(model.names) < 2:
        return known

    def told(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
        bodies = [b for b in map(prose, batch.column(0).to_pylist()) if b]
        distinct = list(dict.fromkeys(bodies))
        scores, size = known.scores(distinct)
        order = np.sort(scores, axis=1)
        sure = order[:, -1] - order[:, -2] > np.maximum(lead, each * size)
        name = {t: known.names[b] for t, b, ok in zip(distinct, scores.argmax(axis=1), sure, strict=True) if ok}
        return ((name[t], t) for t in bodies if t in name)

    counts = model.counts.copy()
    for lang, more in _counted(texts, told).items():
        counts[:, model.names.index(lang)] += more
    return Languages(model.names, _table(counts))


def learn(documents: DataFrame) -> Languages:
    """The model of all labelled rows; every language counts alike."""
    labelled = documents.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").isNotNull()).select(label(F.col("lang")), "text")
    found = _counted(labelled, lambda batch: zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    if not found:
        return Languages((), np.zeros((BUCKETS, 1), dtype=np.float32))
    counts = np.stack(list(found.values()), axis=1) + _SMOOTH
    return Languages(tuple(found), _table(counts), counts)
