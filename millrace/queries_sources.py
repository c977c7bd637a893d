"""Queries: scans and sinks by round trip through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.runtime import stage_dir, table
from millrace.sources import io


def _at(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark)}/{uuid.uuid4().hex}-{name}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATION)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, at = _nation(spark, sf_dir), _at(spark, "t.jsonl")
    io.write_same_format(df, at)
    return io.read_metadata(spark, at, df.schema)


@query(_NATION)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, at = _nation(spark, sf_dir), _at(spark, "t.csv")
    io.write_same_format(df, at)
    return io.read_metadata(spark, at, df.schema)


@query("SELECT conv_id, image, num_tokens, len(input_ids) AS n FROM (SELECT conv_id, any_value(image) AS image, any_value(num_tokens) AS num_tokens, any_value(input_ids) AS input_ids FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)")
def stage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached stage keeps the columns that are needed later."""
    at = _at(spark, "stage.parquet")
    df = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").dropDuplicates(["conv_id"])
    io.write_stage(df, at, ["conv_id", "image", "num_tokens", "input_ids", "data_path"], drop=("data_path",))
    return io.read_metadata(spark, at).select("conv_id", "image", "num_tokens", F.when(F.col("input_ids").isNotNull(), F.size("input_ids").cast("bigint")).alias("n"))


@query("SELECT ceil(count(*) / 1000)::BIGINT <= 1000000 AS bounded, count(*) AS n FROM part")
def shards_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most a thousand rows."""
    at = _at(spark, "shards")
    io.write_shards(table(spark, sf_dir, "part").select("p_partkey"), at, 1000)
    back = spark.read.schema("p_partkey bigint").json(at).withColumn("file", F.input_file_name())
    per = back.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.max("n") <= 1000).alias("bounded"), F.sum("n").alias("n"))


@query("SELECT s_suppkey, (s_suppkey % 2 = 0)::INT AS first_run FROM supplier")
def resume_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run writes only what the first has left."""
    at = _at(spark, "resume")
    df = table(spark, sf_dir, "supplier").select("s_suppkey")
    io.resume_write(df.where("s_suppkey % 2 = 0").withColumn("first_run", F.lit(1)), at, "s_suppkey")
    io.resume_write(df.withColumn("first_run", F.lit(0)), at, "s_suppkey")
    return spark.read.parquet(at)


@query("SELECT stem, length(stem)::INT AS n FROM (SELECT 'f' || n_nationkey AS stem FROM nation)")
def listing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file pair per nation, listed and paired by folder and stem."""
    at = _at(spark, "files")
    fs, _ = io.hadoop_path(spark, at)
    for r in _nation(spark, sf_dir).collect():  # twenty-five small files
        for ext in ("a", "b"):
            out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/f{r['n_nationkey']}.{ext}"))
            out.write(65)
            out.close()
    pairs = io.pair_listing(io.list_files(spark, at, "a", "b"), "a", "b")
    return pairs.select("stem", F.length("stem").alias("n"))


@query("SELECT n_nationkey, 'twice' AS data_path FROM nation UNION ALL SELECT n_nationkey, 'twice' FROM nation UNION ALL SELECT n_nationkey, 'once' FROM nation")
def catalog_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "catalog.parquet")
    _nation(spark, sf_dir).write.parquet(at)
    return io.read_catalog(spark, "twice%200,once", {"twice": {"path": at}, "once": {"path": at}}, "n_nationkey").select("n_nationkey", "data_path")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def split_of_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "splits")
    _nation(spark, sf_dir).select("n_nationkey", F.when(F.col("n_regionkey") == 1, "val").otherwise("train").alias("split")).write.parquet(at)
    return io.read_split(spark, f"{at}@val").select("n_nationkey")


@query("SELECT * FROM (VALUES (1, 'loss', 0.5), (1, 'kl', 0.1), (2, 'loss', 0.25)) t(step, key, value)")
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "metrics")
    io.append_metrics(spark, at, 1, {"loss": 0.5, "kl": 0.1})
    io.append_metrics(spark, at, 2, {"loss": 0.25})
    return spark.read.parquet(at).withColumn("value", F.col("value").cast("decimal(3,2)"))


_REF = "(SELECT ref_id, any_value(sentences) AS s FROM refs WHERE ref_id IS NOT NULL GROUP BY ref_id)"


@query(f"SELECT ref_id, list_transform(s, lambda x: x.sent_id * 2) AS doubled FROM {_REF}")
def nested_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every sentence written into the nested records."""
    rows = table(spark, sf_dir, "refs").where("ref_id IS NOT NULL").select("ref_id", "sentences").dropDuplicates(["ref_id"])
    said = rows.select("ref_id", F.posexplode("sentences").alias("pos", "s")).select("ref_id", "pos", (F.col("s.sent_id") * 2).alias("value"))
    return io.add_predictions(rows, said, "ref_id", "sentences", "twice").select("ref_id", F.transform("sentences", lambda s: s["twice"]).alias("doubled"))


@query("""
SELECT 'refs' AS kind, count(DISTINCT ref_id) AS n FROM refs WHERE ref_id IS NOT NULL UNION ALL SELECT 'images', count(DISTINCT id) FROM images UNION ALL SELECT 'categories', count(*) FROM categories""")
def referring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A referring-expression set as its two JSON files, read as tables."""
    refs_at, at = _at(spark, "refs.json"), _at(spark, "instances.json")
    first = lambda t, k: table(spark, sf_dir, t).where(F.col(k).isNotNull()).dropDuplicates([k])
    first("refs", "ref_id").select("ref_id", "ann_id", "category_id", "image_id", "split", "sentences").write.json(refs_at)
    kinds = {"images": first("images", "id").select("id", "file_name", "height", "width"), "categories": table(spark, sf_dir, "categories")}
    for name, df in kinds.items():
        df.write.json(f"{at}/{name}")
    tables = io.read_referring(spark, refs_at, {name: f"{at}/{name}" for name in kinds})
    parts = [tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kind"), "n") for n in ("refs", "images", "categories")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT step::BIGINT AS step FROM (SELECT unnest(range(1, 26)) AS step) WHERE step % 10 = 0 OR step = 25")
def saved_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth step and the last one are saved."""
    return io.steps_to_save(spark.range(1, 26).withColumnRenamed("id", "step"), "step", 10, 25)
