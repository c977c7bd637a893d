"""Positional batch algebra: row ids, chunks, repeats, slices, padding, column union, renames.

Positions come from ``row_ids``: a distributed sort, the row count of every
sorted partition (one number each) and an offset per partition.  No operator
here ranks rows in a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.runtime import materialize

RID = "_rid"


def row_ids(df: DataFrame, *order: str | Column) -> DataFrame:
    """``_rid`` 0, 1, 2, ... in the given order, without a single-task window."""
    cut = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "rid")
    part, within = F.shiftright("_m", 33).cast("int"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in cut.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per partition
    start, at = {}, 0
    for p in sorted(sizes):
        start[p] = at
        at += sizes[p]
    if not start:
        return cut.withColumn(RID, F.lit(0).cast("bigint")).drop("_m")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), part)
    return cut.withColumn(RID, (offset + within).cast("bigint")).drop("_m")


def chunk(df: DataFrame, parts: int, n: int) -> DataFrame:
    """Equal contiguous parts; ``n`` rows that do not divide are an error."""
    if n % parts:
        raise ValueError(f"{n} rows do not divide into {parts}")
    return split(df, n // parts).withColumnRenamed("part", "chunk")


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("part", F.floor(F.col(RID) / size).cast("bigint"))


def repeat(df: DataFrame, times: int, n: int, interleave: bool = True) -> DataFrame:
    """Rows repeated one by one (aabb) or as a whole (abab), with new positions."""
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    rid = F.col(RID) * times + F.col("_k") if interleave else F.col("_k").cast("bigint") * n + F.col(RID)
    return copies.withColumn(RID, rid).drop("_k")


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    keep = (F.col(RID) >= start) & (F.pmod(F.col(RID) - start, F.lit(step)) == 0)
    return df.where(keep if end is None else keep & (F.col(RID) < end))


def index_select(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by an index table ``pos, idx`` (order and repeats kept)."""
    return df.join(index, df[RID] == index["idx"]).drop("idx").withColumn(RID, F.col("pos")).drop("pos")


def pad_to_divisor(df: DataFrame, n: int, divisor: int) -> DataFrame:
    """The first rows again, in a cycle, until the row count divides."""
    extra = -n % divisor
    if not extra or not n:
        return df
    head = df.where(F.col(RID) < min(extra, n)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((extra - 1) // n))))
    more = head.withColumn(RID, F.lit(n) + F.col("_k") * n + F.col(RID)).where(F.col(RID) < n + extra).drop("_k")
    return df.unionByName(more)


def unpad(df: DataFrame, n: int, extra: int) -> DataFrame:
    return df.where(F.col(RID) < n - extra)


def fold(df: DataFrame, size: int, column: str) -> DataFrame:
    """Consecutive rows folded into arrays of bounded size."""
    folded = df.groupBy(F.floor(F.col(RID) / size).cast("bigint").alias("row")).agg(F.array_sort(F.collect_list(F.struct(RID, column))).alias("v"))
    return folded.select("row", F.transform("v", lambda s: s[column]).alias(column))


def interleave_ranks(df: DataFrame, rank: str, step: str, ranks: int, n: int) -> DataFrame:
    """Results that ``ranks`` workers gave in turn, back in the order of the data set and cut at its ``n`` rows."""
    return df.withColumn(RID, (F.col(step) * ranks + F.col(rank)).cast("bigint")).where(F.col(RID) < n)


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def column_union(a: DataFrame, b: DataFrame, on: str = RID) -> DataFrame:
    """Column-wise union of two batches; columns both have must agree."""
    shared = [c for c in b.columns if c in a.columns and c != on]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    out = a.join(right, on)
    for c in shared:
        same = F.assert_true(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(f"column {c} differs"))
        out = out.where(same.isNull()).drop(f"_b_{c}")
    return out


def select_existing(df: DataFrame, *names: str) -> DataFrame:
    """The named columns that exist; missing names are ignored."""
    return df.select(*[c for c in names if c in df.columns])


def pop(df: DataFrame, *names: str, key: str = RID) -> tuple[DataFrame, DataFrame]:
    """(the popped columns with the key, the rest)."""
    kept = [c for c in names if c in df.columns]
    return df.select(key, *kept), df.drop(*kept)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def flatten_columns(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns ``a/b/c``."""

    def walk(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def unflatten_columns(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns ``a/b/c`` as nested structs."""
    tree: dict = {}
    for c in df.columns:
        at = tree
        *path, leaf = c.split(sep)
        for p in path:
            at = at.setdefault(p, {})
        at[leaf] = c

    def build(node: dict, name: str) -> Column:
        return F.struct(*[build(v, k) if isinstance(v, dict) else F.col(f"`{v}`").alias(k) for k, v in node.items()]).alias(name)

    return df.select(*[build(v, k) if isinstance(v, dict) else F.col(f"`{v}`").alias(k) for k, v in tree.items()])


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A batch from named lists of one length; lists of different lengths are an error."""
    sizes = {k: len(v) for k, v in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"lengths differ: {sizes}")
    rows = list(zip(range(next(iter(sizes.values()), 0)), *columns.values(), strict=True))
    return spark.createDataFrame(rows, f"{RID} bigint, {schema}")


def check_lengths(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of a batch in which the array columns do not have one length: none in a sound batch."""
    sizes = F.array_distinct(F.array(*[F.size(c) for c in columns]))
    return df.where(F.size(sizes) > 1)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two batches hold the same rows, repeats counted."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replicate_to_all(df: DataFrame, workers: int) -> DataFrame:
    """Every row once for each worker."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def sequence_parts(df: DataFrame, column: str, parts: int, fill: Column) -> DataFrame:
    """``df`` with ``part`` and its slice of an array padded to a multiple of ``parts``."""
    n = F.size(column)
    size = F.ceil(n / parts).cast("int")
    padded = F.concat(F.col(column), F.array_repeat(fill, size * parts - n))
    return df.withColumn("_s", padded).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).withColumn(column, F.slice("_s", F.col("part") * size + 1, size)).drop("_s")


def join_parts(df: DataFrame, key: str, column: str, length: str) -> DataFrame:
    """The slices of ``sequence_parts`` put together again and cut at the old length."""
    whole = df.groupBy(key, length).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", column))), lambda s: s[column])).alias(column))
    return whole.withColumn(column, F.slice(column, F.lit(1), F.col(length)))


def restore(df: DataFrame) -> DataFrame:
    """Rows of dynamic batches in their old order (a distributed sort by position)."""
    return df.orderBy(RID)


def stand_in(df: DataFrame, bad: Column, n: int, seed: int = 0) -> DataFrame:
    """``_rid, source``: every position with the position to read instead: itself, or for a bad row another one by hash."""
    other = F.pmod(F.xxhash64(F.lit(seed), RID), F.lit(max(1, n - 1)))
    shifted = F.when(other >= F.col(RID), other + 1).otherwise(other)  # never itself
    return df.select(RID, F.when(F.coalesce(bad, F.lit(True)) & F.lit(n > 1), shifted).otherwise(F.col(RID)).cast("bigint").alias("source"))


def batch_rewards(df: DataFrame, reward: Callable[[list[dict]], list[dict]], columns: list[str], schema: str, key: str) -> DataFrame:
    """``key`` and the fields of a reward function of one's own that scores a list of records at once, called per Arrow batch."""
    names = [f.split()[0] for f in schema.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = reward(b[columns].to_dict("records"))
            if len(scores) != len(b):
                raise ValueError(f"{len(scores)} scores for {len(b)} records")
            yield pd.DataFrame({key: b[key], **{n: [s.get(n) for s in scores] for n in names}})

    return df.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, {schema}")


def within_length(df: DataFrame, column: str, most: int) -> DataFrame:
    """Rows whose array has at most ``most`` elements; null arrays have none."""
    return df.where(F.coalesce(F.size(F.col(column)), F.lit(0)) <= most)


def route_by_type(df: DataFrame, column: str, routes: dict[str, Op], default: Op | None = None) -> DataFrame:
    """The operator of a column's type name; another type without a default is an error."""
    kind = df.schema[column].dataType.typeName()
    op = routes.get(kind, default)
    if op is None:
        raise ValueError(f"no route for {kind}")
    return df.withColumn(column, op(F.col(column)))


def prefix_structs(df: DataFrame, *prefixes: str) -> DataFrame:
    """Columns of a common prefix gathered in one struct each."""
    out = df
    for p in prefixes:
        mine = [c for c in df.columns if c.startswith(p + "_")]
        if mine:
            out = out.withColumn(p, F.struct(*[F.col(c).alias(c[len(p) + 1 :]) for c in mine])).drop(*mine)
    return out


class Op:
    """A Column function that composes left to right with ``>>``; composition makes a new operator."""

    def __init__(self, *steps) -> None:
        self.steps = steps

    def __call__(self, column: Column) -> Column:
        return reduce(lambda c, f: f(c), self.steps, column)

    def __rshift__(self, other) -> Op:
        return Op(*self.steps, *(other.steps if isinstance(other, Op) else (other,)))

    def over_list(self) -> Op:
        return Op(lambda c: F.transform(c, self))


identity, to_int, to_float = Op(), Op(lambda c: c.cast("int")), Op(lambda c: c.cast("double"))
to_list = Op(lambda c: F.array(c))


def to_text(none: str = "") -> Op:
    return Op(lambda c: F.coalesce(c.cast("string"), F.lit(none)))


def apply_to(df: DataFrame, keys: list[str], main: Op, special: dict[str, Op] | None = None) -> DataFrame:
    """The operator of each listed key that exists; other columns pass through."""
    special = special or {}
    return df.withColumns({k: special.get(k, main)(F.col(k)) for k in keys if k in df.columns})


def mini_batches(df: DataFrame, n: int, size: int, epochs: int, seed: int | None = None) -> DataFrame:
    """``epoch, step`` of every row; with a seed each epoch has its own order (positions by hash, not by a single-task sort)."""
    if n % size:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return each.withColumn("step", F.floor(F.col(RID) / size).cast("bigint"))
    placed = row_ids(each.withColumnRenamed(RID, "_row"), "epoch", F.xxhash64(F.lit(seed), "epoch", "_row"), "_row")
    return placed.withColumn("step", F.floor((F.col(RID) - F.col("epoch") * n) / size).cast("bigint")).drop(RID).withColumnRenamed("_row", RID)


def loader_batches(df: DataFrame, n: int, size: int, drop_last: bool) -> DataFrame:
    """Fixed batches over positions; the incomplete last one is dropped on demand."""
    out = df.withColumn("batch", F.floor(F.col(RID) / size).cast("bigint"))
    return out.where(F.col("batch") < n // size) if drop_last else out


def contiguous_ids(categories: DataFrame, key: str, flag: str) -> DataFrame:
    """``key, flag, index``: contiguous indices in key order (positions over the whole list, split by the flag)."""
    return row_ids(categories.select(key, flag), key).withColumnRenamed(RID, "index")
