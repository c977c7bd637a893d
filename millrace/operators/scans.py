"""Running values along groups of any size, as distributed linear recurrences.

``run[t] = add[t] + keep[t] * run[t-1]`` covers running sums and counts, returns
to go, discounted returns, advantages, positions, ranks and last known values.
A window would sort a whole group in one task.  Here the rows are range-sorted
by group and order together, so a group that holds a third of all rows is spread
over many tasks; every task solves its part as if nothing came before it and
notes how much of an incoming value would remain (the product of the factors).
One row per partition reaches the driver, which chains the values over the
partition borders; the rows are then corrected by a plain expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from millrace.runtime import materialize

_INNER = ("_scan_key", "_scan_add", "_scan_keep", "_scan_part", "_scan_at", "_scan_run", "_scan_left", "_scan_before", "_scan_before_left")


def forward(add: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, products of the factors) of the recurrence over one stretch, by doubling."""
    y, c, step = add.copy(), keep.copy(), 1
    while step < len(y):
        y[step:] += c[step:] * y[:-step].copy()
        c[step:] *= c[:-step].copy()
        step *= 2
    return y, c


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    run, left, key, at = 0.0, 1.0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(batch.schema.get_field_index("_scan_key"))
        number = lambda c: np.nan_to_num(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float))
        fresh = np.zeros(n, dtype=bool)  # rows that begin a group
        fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = key is not None and keys[0].as_py() != key
        add, keep = number("_scan_add"), np.where(fresh, 0.0, number("_scan_keep"))
        y, c = forward(add, keep)
        y, rest = y + c * run, c * left
        before, before_rest = np.concatenate(([run], y[:-1])), np.concatenate(([left], rest[:-1]))
        before, before_rest = np.where(fresh, 0.0, before), np.where(fresh, 0.0, before_rest)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n)), *(pa.array(x) for x in (y, rest, before, before_rest))],
            [*batch.schema.names, *_INNER[3:]],
        )
        run, left, key, at = float(y[-1]), float(rest[-1]), keys[n - 1].as_py(), at + n


def running(df: DataFrame, keys: list[str], order: list[Column | str], add: Column, keep: Column | None = None, out: str = "run") -> DataFrame:
    """``df`` with ``out`` and ``{out}_before`` (the value one row earlier, 0 at the start of a group).

    Null keys form groups like any value; a null ``add`` or ``keep`` counts as 0.
    ``order`` must tell rows of a group apart, else ties fall in any order.
    """
    spark = df.sparkSession
    told = df.withColumns({"_scan_key": F.to_json(F.struct(*keys)), "_scan_add": add.cast("double"), "_scan_keep": (F.lit(1.0) if keep is None else keep).cast("double")})
    more = [StructField("_scan_part", IntegerType()), StructField("_scan_at", LongType()), *[StructField(c, DoubleType()) for c in _INNER[5:]]]
    placed = told.orderBy("_scan_key", *order)
    solved = materialize(placed.mapInArrow(_solve, StructType([*placed.schema.fields, *more])), "scan")
    ends = solved.groupBy("_scan_part").agg(F.min_by("_scan_key", "_scan_at").alias("first"), F.max_by(F.struct("_scan_key", "_scan_run", "_scan_left"), "_scan_at").alias("last")).orderBy("_scan_part").collect()  # a row per partition
    carry: dict[int, float] = {}
    key, value = None, 0.0
    for e in ends:
        carry[e["_scan_part"]] = value if e["first"] == key else 0.0
        key, value = e["last"]["_scan_key"], e["last"]["_scan_run"] + e["last"]["_scan_left"] * carry[e["_scan_part"]]
    came = spark.createDataFrame(list(carry.items()), "_scan_part int, _scan_carry double")
    whole = solved.join(F.broadcast(came), "_scan_part")  # as many rows as partitions
    mend = lambda v, w: F.when(F.col(w) == 0, F.col(v)).otherwise(F.col(v) + F.col(w) * F.col("_scan_carry"))
    return whole.withColumns({out: mend("_scan_run", "_scan_left"), f"{out}_before": mend("_scan_before", "_scan_before_left")}).drop(*_INNER, "_scan_carry")


def running_count(df: DataFrame, keys: list[str], order: list[Column | str], flag: Column, out: str) -> DataFrame:
    """Flagged rows of a group up to and including each row."""
    done = running(df, keys, order, flag.cast("double"), out=out)
    return done.withColumn(out, F.col(out).cast("bigint")).withColumn(f"{out}_before", F.col(f"{out}_before").cast("bigint"))
