"""Structured Streaming counterparts: windowed counts with lateness, filtered batch filling, stateful choice, resumable steps."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.runtime import materialize


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, time: str, window: str, lateness: str, *keys: str) -> DataFrame:
    """Rows per window and keys; rows later than the watermark are dropped by Spark."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("_t", at).withWatermark("_t", lateness).groupBy(F.window("_t", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def choose_without_repeat(stream: DataFrame, key: str, item: str, seed: int = 0) -> DataFrame:
    """One item per key and trigger, none twice until all were chosen (state: what is left of each key)."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = list(state.get[0]) if state.exists else []
        seen = {x for f in frames for x in f[item]}
        pool = left or sorted(seen)
        pick = pool[zlib.crc32(f"{seed}|{len(pool)}|{k}".encode()) % len(pool)]
        state.update(([x for x in pool if x != pick],))
        yield pd.DataFrame({key: [k[0]], "chosen": [pick]})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, chosen {kinds[item]}", f"left array<{kinds[item]}>", "update", GroupStateTimeout.NoTimeout
    )


def fill_batches(batches: Iterator[DataFrame], keep: Callable[[DataFrame], DataFrame], size: int, tries: int, order: str) -> DataFrame:
    """Pull batches, filter groups, gather until ``size`` rows are there; too many pulls are an error.

    What a pull keeps is written and counted once; earlier pulls are not looked at again.
    """
    got: list[DataFrame] = []
    total = 0
    for n, batch in enumerate(batches, 1):
        kept = materialize(keep(batch), "pull")
        got.append(kept)
        total += kept.count()
        if total >= size:
            return reduce(lambda a, b: a.unionByName(b), got).orderBy(order).limit(size)
        if n >= tries:
            break
    raise ValueError(f"fewer than {size} rows after {tries} batches")


def run_stream(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is, once, resumable from the checkpoint."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
