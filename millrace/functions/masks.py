"""Masks as run lengths: the coded-string form, polygon fill, areas, unions, nesting.

Codes and fills need loops over bytes or pixels and run as Arrow-batched Pandas
UDFs; areas, unions and containment of run lengths stay in the JVM.  Runs go
down the columns, the first run counts zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def encode_counts(counts: list[int]) -> str:
    """Run lengths to the coded string: from the third run on the difference to the run before last, in groups of five bits."""
    out = bytearray()
    for i, c in enumerate(counts):
        x = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            bits, x = x & 31, x >> 5
            last = x == (-1 if bits & 16 else 0)
            out.append((bits if last else bits | 32) + 48)
            if last:
                break
    return out.decode()


def decode_counts(text: str) -> list[int] | None:
    """The coded string to run lengths; null where it is not one."""
    counts: list[int] = []
    x = shift = 0
    for b in text.encode("utf-8", "replace"):
        v = b - 48
        if not 0 <= v < 64:
            return None
        x |= (v & 31) << shift
        shift += 5
        if not v & 32:
            if v & 16:
                x |= -1 << shift
            counts.append(x + counts[-2] if len(counts) > 2 else x)
            x = shift = 0
    return None if shift else counts


@F.pandas_udf(ArrayType(IntegerType()))
def runs_of_code(code: pd.Series) -> pd.Series:
    return code.map(lambda c: decode_counts(c) if c is not None else None)


@F.pandas_udf(StringType())
def code_of_runs(runs: pd.Series) -> pd.Series:
    return runs.map(lambda r: encode_counts(list(r)) if r is not None else None)


def fill_polygon(coords: np.ndarray, height: int, width: int) -> np.ndarray:
    """Even-odd fill of one ring at pixel centres."""
    xy = np.asarray(coords, dtype=float).reshape(-1, 2)
    turn = np.zeros((height, width + 1), dtype=np.int8)  # crossings of every row, at the first centre right of them
    for (xa, ya), (xb, yb) in zip(xy, np.roll(xy, -1, axis=0), strict=True):
        if ya > yb:
            xa, ya, xb, yb = xb, yb, xa, ya
        rows = np.arange(max(0, int(np.ceil(ya - 0.5))), min(height, int(np.ceil(yb - 0.5))))
        if len(rows):
            cross = xa + (rows + 0.5 - ya) / (yb - ya) * (xb - xa)
            np.add.at(turn, (rows, np.clip(np.ceil(cross - 0.5).astype(int), 0, width)), 1)
    return np.cumsum(turn[:, :width], axis=1, dtype=np.int8) % 2 == 1


def runs_of_bitmap(mask: np.ndarray) -> list[int]:
    flat = np.concatenate([[0], np.asarray(mask, dtype=np.int8).ravel(order="F")])
    edges = np.flatnonzero(np.diff(flat)) + 0
    return np.diff(np.concatenate([[0], edges, [len(flat) - 1]])).astype(int).tolist()


@F.pandas_udf(ArrayType(IntegerType()))
def runs_of_polygon(coords: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for c, h, w in zip(coords, height, width, strict=True):
        ok = c is not None and h == h and w == w and h is not None and len(c) >= 6 and len(c) % 2 == 0
        out.append(runs_of_bitmap(fill_polygon(c, int(h), int(w))) if ok else None)
    return pd.Series(out)


def area(runs: Column) -> Column:
    """Pixels set: the odd runs."""
    return F.aggregate(F.transform(runs, lambda c, i: F.when(i % 2 == 1, c).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _edges(runs) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(runs, dtype=np.int64))))


def _ranges(runs) -> list[tuple[int, int]]:
    """The set runs as half-open pixel ranges."""
    e = _edges(runs)
    pairs = [(int(x), int(y)) for x, y in zip(e[1:-1:2], e[2::2], strict=True)]
    return [(x, y) for x, y in pairs if y > x]


@F.pandas_udf(ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())])))
def intervals(runs: pd.Series) -> pd.Series:
    return runs.map(lambda r: None if r is None else [{"a": x, "b": y} for x, y in _ranges(r)])


def shared_pixels(a, b) -> int:
    """Pixels two masks share: the set pixels of ``b`` before each end of a set run of ``a``."""
    ea, eb = _edges(a), _edges(b)
    if len(ea) < 3 or len(eb) < 3:
        return 0
    upto = np.concatenate(([0], np.cumsum(np.where(np.arange(len(b)) % 2 == 1, np.asarray(b, dtype=np.int64), 0))))
    before = lambda x: np.interp(x, eb, upto)  # noqa: E731 - piecewise linear, exact at whole numbers
    k = (len(ea) - 1) // 2
    return int(round(float((before(ea[2 : 2 * k + 1 : 2]) - before(ea[1 : 2 * k : 2])).sum())))


def pixels(runs) -> int:
    return int(np.asarray(runs, dtype=np.int64)[1::2].sum())


def iou_matrix(truth, predicted, eps: float = 1e-7) -> np.ndarray:
    """IoU of every mask of one list with every mask of another, within [0, 1]."""
    out = np.zeros((len(truth), len(predicted)))
    area_t, area_p = [pixels(t) for t in truth], [pixels(p) for p in predicted]
    for i, t in enumerate(truth):
        for j, p in enumerate(predicted):
            both = shared_pixels(t, p)
            out[i, j] = both / (area_t[i] + area_p[j] - both + eps)
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(DoubleType())
def iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """IoU of two run-length masks; 0 where both are empty, null where one is null."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        both = shared_pixels(x, y)
        union = pixels(x) + pixels(y) - both
        out.append(both / union if union else 0.0)
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def matched_iou(truth: pd.Series, predicted: pd.Series) -> pd.Series:
    """Sum of the IoUs of the best one-to-one matching of two lists of masks over the longer list; 1 where both are null, 0 where one is."""
    from millrace.operators.balance import assign

    out = []
    for t, p in zip(truth, predicted, strict=True):
        if t is None or p is None:
            out.append(1.0 if t is None and p is None else 0.0)
        elif not len(t) and not len(p):
            out.append(1.0)
        else:
            m = iou_matrix(t, p)
            out.append(sum(m[i, j] for i, j in assign(m)) / max(len(t), len(p)))
    return pd.Series(out)


def _covered(masks) -> int:
    """Pixels set in any of several masks: their ranges in order, each counted from where the ones before it end."""
    edges = [_edges(r) for r in masks]
    first = np.concatenate([e[1:-1:2] for e in edges]) if edges else np.zeros(0, dtype=np.int64)
    last = np.concatenate([e[2::2] for e in edges]) if edges else first
    if not len(first):
        return 0
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    seen = np.concatenate(([0], np.maximum.accumulate(last)[:-1]))
    return int(np.maximum(last - np.maximum(first, seen), 0).sum())


@F.pandas_udf(LongType())
def covered_pixels(masks: pd.Series) -> pd.Series:
    return masks.map(_covered)


def union_area(masks: DataFrame, key: str, runs: str) -> DataFrame:
    """``key, area``: pixels covered by any mask of a key."""
    return masks.groupBy(key).agg(F.collect_list(runs).alias("r")).select(key, covered_pixels("r").alias("area"))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def kept_masks(masks: pd.Series) -> pd.Series:
    """Masks (lists of run lengths) without those that lie wholly in a larger kept one, largest first; of equal ones the first stays."""

    def keep(ms):
        kept: list = []
        for m in sorted(ms, key=lambda x: -pixels(x)):  # a stable order
            n = pixels(m)
            if not (n and any(shared_pixels(m, k) == n for k in kept)):
                kept.append(m)
        return [np.asarray(k, dtype=np.int32) for k in kept]

    return masks.map(lambda ms: None if ms is None else keep(ms))


def drop_nested(masks: Column) -> Column:
    """``kept_masks`` of ``array<struct<runs>>``."""
    return kept_masks(F.transform(masks, lambda m: m["runs"].cast("array<int>")))
