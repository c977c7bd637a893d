"""Queries: streaming and position layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.registry import query
from millrace.runtime import stage_dir, table
from millrace.streaming import incremental


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return incremental.read_stream(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)  # a pattern: the table may be one file or a folder


def _settled(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and read the state after the last batch."""
    spark = stream.sparkSession
    at = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    incremental.for_each_batch(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out"), f"{at}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _stream(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _settled(totals, "complete")


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = incremental.tumbling_counts(_stream(spark, sf_dir, "events"), "ts", "1 day", "2 days", "event_type")
    return _settled(counts, "complete").select(F.unix_timestamp("window_start").alias("day"), "event_type", "n")


@query("""
SELECT p_partkey, (k < 3)::INT AS is_text, (CASE WHEN k < 3 THEN k ELSE 3 + (k - 3) // (2 * (2 + p_size % 2)) END)::INT AS t, (CASE WHEN k < 3 THEN k ELSE 3 + ((k - 3) // (2 + p_size % 2)) % 2 END)::INT AS h,
  (CASE WHEN k < 3 THEN k ELSE 3 + (k - 3) % (2 + p_size % 2) END)::INT AS w FROM part, (SELECT unnest(range(0, 15)) AS k) WHERE k < 3 + 2 * 2 * (2 + p_size % 2)""")
def grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("int")
    text = F.struct(F.lit(3).alias("n"), none.alias("t"), none.alias("h"), none.alias("w"))
    grid = F.struct(F.lit(0).alias("n"), F.lit(2).alias("t"), F.lit(4).alias("h"), ((F.col("p_size") % 2 + 2) * 2).cast("int").alias("w"))
    pos = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(arrays.grid_positions(F.array(text, grid))).alias("k", "p"))
    return pos.select("p_partkey", (F.col("k") < 3).cast("int").alias("is_text"), "p.t", "p.h", "p.w")
