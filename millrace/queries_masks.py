"""Queries: masks as run lengths, multi-round metrics, mini-batches, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import masks
from millrace.operators import aggregates, batch, nested
from millrace.registry import query
from millrace.runtime import table

def _run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length masks wherever they stand: alone, in any list, as JSON inside JSON, in the column ``counts``."""
    return nested.masks(table(spark, sf_dir, "annotations")).where(F.col("kind") == "run_lengths").select("parent_id", "child_pos", "runs")


@query()
def mask_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_lengths(spark, sf_dir).select("parent_id", "child_pos", masks.area(F.col("runs")).alias("area"))


@query()
def mask_union_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty masks keep their row with area 0."""
    return masks.union_area(_run_lengths(spark, sf_dir), "parent_id", "runs")


@query()
def coded_mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = nested.masks(table(spark, sf_dir, "annotations")).where(F.col("kind") == "coded_mask")
    runs = coded.select("parent_id", "child_pos", masks.runs_of_code(F.col("coded")).alias("runs"))
    return runs.select("parent_id", "child_pos", F.size("runs").alias("n_runs"), masks.code_of_runs(F.col("runs")).alias("again"))


@query()
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "images").where("id IS NOT NULL AND height IS NOT NULL AND width IS NOT NULL").groupBy(F.col("id").alias("image_id")).agg(F.max("height").alias("h"), F.max("width").alias("w"))
    owner = table(spark, sf_dir, "annotations").where("id IS NOT NULL").groupBy(F.col("id").alias("parent_id")).agg(F.max("image_id").alias("image_id"))
    polys = nested.polygons(table(spark, sf_dir, "annotations")).join(owner, "parent_id").join(size, "image_id")
    return polys.select("parent_id", "child_pos", masks.area(masks.runs_of_polygon(F.col("coords"), F.col("h"), F.col("w"))).alias("area"))


@query("""
WITH i AS (SELECT o_custkey AS k, o_orderkey % 50 AS i, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 50 + o_custkey % 60 END AS u, o_orderkey % 5 <> 0 AS p FROM orders),
c AS (SELECT k, sum(CASE WHEN NOT p THEN 0.0 WHEN u = 0 THEN 1.0 ELSE i / (u + 1e-5) END) AS s, count(*) AS n, sum(CASE WHEN p THEN i END) AS i, sum(CASE WHEN p THEN u END) AS u FROM i GROUP BY k)
SELECT round(sum(i) / (sum(u) + 1e-10), 6) AS c_iou, round(sum(s / n * n) / sum(n), 6) AS g_iou, sum(n)::BIGINT AS n_masks FROM c""")
def multi_round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    items = table(spark, sf_dir, "orders").select(c.alias("k"), (o % 50).alias("i"), F.when(o % 11 == 0, 0).otherwise(o % 50 + c % 60).alias("u"), (o % 5 != 0).alias("p"))
    return aggregates.multi_round_metrics(items, "k", "i", "u", "p").select(F.round("c_iou", 6).alias("c_iou"), F.round("g_iou", 6).alias("g_iou"), "n_masks")


@query("""SELECT n_nationkey, e.e::INT AS epoch, ((row_number() OVER (PARTITION BY e.e ORDER BY n_nationkey) - 1) // 5)::BIGINT AS step FROM nation, (SELECT unnest(range(2)) AS e) e""")
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = batch.row_ids(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    return batch.mini_batches(df, 25, 5, 2).select("n_nationkey", "epoch", "step")


@query("""SELECT n_nationkey, ((row_number() OVER (ORDER BY n_nationkey) - 1) // 4)::BIGINT AS batch FROM nation QUALIFY batch < 6""")
def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = batch.row_ids(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    return batch.loader_batches(df, 25, 4, drop_last=True).select("n_nationkey", "batch")


@query("""SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS index, id % 3 = 0 AS thing FROM categories""")
def contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.contiguous_ids(table(spark, sf_dir, "categories").select("id", (F.col("id") % 3 == 0).alias("thing")), "id", "thing")


@query("""
SELECT event_type, round(sum(value) / (sum(user_id % 7 + 1) * 8), 6) AS tokens_per_device_second, round((6000.0 * sum(user_id) + 12.0 * 2 * 4 * 8 * sum(user_id * user_id)) / 1e6, 6) AS mflops FROM events GROUP BY event_type""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(aggregates.throughput(F.col("value"), u % 7 + 1, 8), 6).alias("tokens_per_device_second"), F.round(aggregates.transformer_flops(u, 1000, 2, 4, 8) / 1e6, 6).alias("mflops")
    )
