"""Balanced partitions, sampling, retention, assignment."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scans import running_count


def _members(tree) -> list[int]:
    """The indices in a tree of pairs, in order."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += t
        elif t is not None:
            out.append(t)
    return sorted(out)


def differencing(sizes: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Largest-differencing partition of a bounded list into ``parts`` index sets of near-equal sums.

    With ``equal_size`` every set has the same number of members (the list must divide).
    Sets are linked, not copied, when two states are merged.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if equal_size and len(sizes) % parts:
        raise ValueError(f"{len(sizes)} do not divide into {parts} equal sets")
    groups = [order[i : i + parts] for i in range(0, len(order), parts)] if equal_size else [[i] for i in order]
    heap = []
    for serial, g in enumerate(groups):
        sums = sorted([(sizes[i], i) for i in g], reverse=True) + [(0, None)] * (parts - len(g))
        heap.append((sums[-1][0] - sums[0][0], serial, sums))
    heapq.heapify(heap)
    serial = len(groups)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sorted([(x[0] + y[0], n, (x[1], y[1])) for n, (x, y) in enumerate(zip(a, reversed(b), strict=True))], key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], serial, [(v, t) for v, _, t in joined]))
        serial += 1
    return [_members(t) for _, t in heap[0][2]] if heap else [[] for _ in range(parts)]


def greedy(sizes: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Every item in turn to the set of least sum (the first of equal ones); with ``equal_size`` a bias keeps the numbers alike."""
    bias = sum(sizes) + 1 if equal_size else 0
    heap, out = [(0, k) for k in range(parts)], [[] for _ in range(parts)]
    for i, s in enumerate(sizes):
        total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (total + s + bias, k))
    if equal_size and any(len(x) * parts != len(sizes) for x in out):
        raise ValueError(f"{len(sizes)} do not divide into {parts} equal sets")
    return out


def _place(run, df: DataFrame, key: str, block: int, **columns: str) -> DataFrame:
    blocks = max(1, -(-df.count() // block))
    schema = df.schema
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).groupBy("_block").applyInPandas(run, schema)


def balance(df: DataFrame, size: str, parts: int, key: str, block: int = 4096) -> DataFrame:
    """``part`` for every row so that the sums per part are near equal, at any row count.

    Rows are cut into blocks of about ``block`` by a hash; every block is
    partitioned in its own task by differencing and its parts, largest first, are
    dealt with a rotation so that the surplus of blocks does not add up.
    """

    def run(pdf):
        pdf = pdf.sort_values([size, key], ascending=[False, True], ignore_index=True)
        sizes = [int(x) for x in pdf[size]]
        shift = int(pdf["_block"].iloc[0]) % parts
        part = np.zeros(len(pdf), dtype=np.int64)
        for p, idx in enumerate(sorted(differencing(sizes, parts), key=lambda s: -sum(sizes[i] for i in s))):
            part[idx] = (p + shift) % parts
        return pdf.drop(columns=["_block"]).assign(part=part)

    return _place(run, df, key, block, part="long")


def dynamic_batches(df: DataFrame, size: str, most: int, key: str, block: int = 4096) -> DataFrame:
    """``batch, micro`` for every row: micro-batches of near-equal sums, at most about ``most`` each, the heaviest (by squared sizes) first.

    A batch is a block of bounded size.  A row larger than ``most`` is an error.
    """

    def run(pdf):
        pdf = pdf.sort_values(key, ignore_index=True)
        sizes = [int(x) for x in pdf[size]]
        if sizes and max(sizes) > most:
            raise ValueError(f"a row of {max(sizes)} is larger than {most}")
        sets = differencing(sizes, micro_batches(len(sizes), sum(sizes), most))
        micro = np.zeros(len(pdf), dtype=np.int64)
        for p, idx in enumerate(sorted(sets, key=lambda s: (sum(sizes[i] ** 2 for i in s), min(s, default=0)), reverse=True)):
            micro[idx] = p
        return pdf.rename(columns={"_block": "batch"}).assign(micro=micro)[[*[c for c in pdf.columns if c != "_block"], "batch", "micro"]]

    return _place(run, df, key, block, batch="long", micro="long")


def reverse_index(index: DataFrame) -> DataFrame:
    """The inverse of a map ``pos, idx``."""
    return index.select(F.col("idx").alias("pos"), F.col("pos").alias("idx"))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def micro_batches(n: int, total: int, most: int) -> int:
    """Micro-batches a batch of ``n`` rows and ``total`` tokens needs."""
    return max(1, min(n, -(-total // most)))


def imbalance(df: DataFrame, part: str, size: str) -> DataFrame:
    per = df.groupBy(part).agg(F.sum(size).alias("s"))
    return per.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("diff"))


def imbalance_report(df: DataFrame, rid: str, part: str, size: str, n: int, parts: int) -> DataFrame:
    """One row ``least, most, diff, balanced_least, balanced_most, mean``: consecutive batches before, parts after balancing."""
    chunk = df.groupBy(F.floor(F.col(rid) / (n // parts)).alias("c")).agg(F.sum(size).alias("s"))
    before = chunk.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("diff"), (F.sum("s") / parts).alias("mean"))
    after = df.groupBy(part).agg(F.sum(size).alias("s")).agg(F.min("s").alias("balanced_least"), F.max("s").alias("balanced_most"))
    return before.join(F.broadcast(after), F.lit(True)).select("least", "most", "diff", "balanced_least", "balanced_most", "mean")  # one row each


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same at every run: the least hashes (distributed top-n)."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def replicate(df: DataFrame, rate: float) -> DataFrame:
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(int(rate))))).drop("_copy")


def retain(df: DataFrame, step: str, keep: int, *protected: int) -> DataFrame:
    """The newest steps and the protected ones."""
    newest = df.select(step).distinct().orderBy(F.desc(step)).limit(keep)
    return df.join(newest, step, "left_semi").unionByName(df.where(F.col(step).isin(*protected)).join(newest, step, "left_anti") if protected else df.limit(0))


def shard(rid: Column, n: int, parts: int) -> Column:
    """Contiguous range shard of a position (ceiling division)."""
    return F.floor(rid / -(-n // parts)).cast("int")


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment of greatest total weight (shortest augmenting paths on potentials)."""
    w = np.asarray(weights, dtype=float)
    if not w.size:
        return []
    flip = w.shape[0] > w.shape[1]
    cost = -(w.T if flip else w)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < slack[free]
            slack[free[better]], way[free[better]] = cur[better], j0
            j1 = free[np.argmin(slack[free])]
            delta = slack[j1]
            u[match[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def rank_boxes(df: DataFrame, image: str, box: str, key: str, mode: str = "ltr-ttb") -> DataFrame:
    """``df`` with ``rank`` from 0 of every box (x, y, width, height) within its image; null where there is no image.

    ``mode``: by centre, x first (``ltr-ttb``) or y first (``ttb-ltr``), or by the upper
    left corner, y first (``tlbr``); ties by ``key``.  A distributed scan: an image with a
    large share of all boxes is ranked by many tasks.
    """
    b = lambda i: F.get(box, F.lit(i))
    x, y = b(0) + b(2) / 2, b(1) + b(3) / 2
    orders = {"ltr-ttb": [x, y], "ttb-ltr": [y, x], "tlbr": [b(1), b(0)]}
    if mode not in orders:
        raise ValueError(f"unknown mode {mode!r}")
    done = running_count(df, [image], [*orders[mode], F.col(key)], F.lit(1), "rank")
    return done.withColumn("rank", F.when(F.col(image).isNotNull(), F.col("rank_before").cast("int"))).drop("rank_before")
