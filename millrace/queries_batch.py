"""Queries: positional algebra, joins, lookups, similarity, sampling, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import balance, batch, joins
from millrace.plans import graph
from millrace.registry import query
from millrace.runtime import table

_R = "(SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS rid FROM nation)"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.row_ids(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query(f"SELECT n_nationkey, (rid // 5)::BIGINT AS chunk FROM {_R}")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.chunk(_nation(spark, sf_dir), 5, 25).select("n_nationkey", "chunk")


@query(f"SELECT n_nationkey, (rid // 4)::BIGINT AS part FROM {_R}")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.split(_nation(spark, sf_dir), 4).select("n_nationkey", "part")


@query(f"SELECT n_nationkey, (rid * 3 + k)::BIGINT AS pos FROM {_R}, (SELECT unnest(range(3)) AS k)")
def repeat_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat(_nation(spark, sf_dir), 3, 25).select("n_nationkey", F.col("_rid").alias("pos"))


@query(f"SELECT n_nationkey, (k * 25 + rid)::BIGINT AS pos FROM {_R}, (SELECT unnest(range(2)) AS k)")
def repeat_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat(_nation(spark, sf_dir), 2, 25, interleave=False).select("n_nationkey", F.col("_rid").alias("pos"))


@query(f"SELECT n_nationkey FROM {_R} WHERE rid >= 3 AND rid < 20 AND (rid - 3) % 4 = 0")
def slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.slice_rows(_nation(spark, sf_dir), 3, 20, 4).select("n_nationkey")


@query(f"SELECT n_nationkey, rid::BIGINT AS pos FROM {_R} UNION ALL SELECT n_nationkey, (25 + rid)::BIGINT FROM {_R} WHERE rid < 7")
def pad_to_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pad_to_divisor(_nation(spark, sf_dir), 25, 8).select("n_nationkey", F.col("_rid").alias("pos"))


@query(f"SELECT n_nationkey, (24 - rid)::BIGINT AS pos FROM {_R}")
def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nation(spark, sf_dir)
    index = df.select((24 - F.col("_rid")).alias("pos"), F.col("_rid").alias("idx"))
    return batch.index_select(df, index).select("n_nationkey", F.col("_rid").alias("pos"))


@query(f"SELECT (rid // 5)::BIGINT AS row, list(n_nationkey ORDER BY rid) AS n_nationkey FROM {_R} GROUP BY 1")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.fold(_nation(spark, sf_dir), 5, "n_nationkey")


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 2 AS double_key FROM nation")
def column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nation(spark, sf_dir)
    return batch.column_union(df, df.select("_rid", "n_name", (F.col("n_nationkey") * 2).alias("double_key"))).drop("_rid")



@query("SELECT s_suppkey, s_name, (s_suppkey // 4 * 4 + s_suppkey % 4)::BIGINT AS pos FROM supplier WHERE s_suppkey // 4 * 4 + s_suppkey % 4 < (SELECT count(*) FROM supplier)")
def interleave_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of four ranks in the order of the data set, cut at its size."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 4).alias("rank"), F.floor(F.col("s_suppkey") / 4).alias("step"))
    return batch.interleave_ranks(df, "rank", "step", 4, df.count()).select("s_suppkey", "s_name", F.col("_rid").alias("pos"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS pos FROM orders")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.row_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("_rid").alias("pos"))


@query("""SELECT c_custkey AS "key/cust", c_nationkey AS "key/geo/nation", c_name FROM customer""")
def flatten_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("cust"), F.struct(F.col("c_nationkey").alias("nation")).alias("geo")).alias("key"), "c_name")
    return batch.flatten_columns(batch.unflatten_columns(batch.flatten_columns(nested)))


@query("SELECT c_custkey, coalesce(c_nationkey::VARCHAR, '') AS c_nationkey, c_acctbal::VARCHAR::DOUBLE::INT AS c_acctbal FROM (SELECT c_custkey, c_nationkey, trunc(c_acctbal) AS c_acctbal FROM customer)")
def operator_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return batch.apply_to(df, ["c_nationkey", "c_acctbal", "absent"], batch.identity >> batch.to_text(""), {"c_acctbal": batch.to_float >> batch.to_int})


_REF1 = "(SELECT ref_id, any_value(ann_id) AS ann_id, any_value(image_id) AS image_id, any_value(category_id) AS category_id, any_value(split) AS split FROM refs WHERE ref_id IS NOT NULL GROUP BY ref_id)"
_ANN1 = "(SELECT id, any_value(category_id) AS category_id, any_value(bbox) AS bbox, any_value(image_id) AS image_id FROM annotations WHERE id IS NOT NULL GROUP BY id)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "refs").where("ref_id IS NOT NULL").select("ref_id", "ann_id", "image_id", "category_id", "split").dropDuplicates(["ref_id"])


def _anns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotations").where("id IS NOT NULL").select("id", "category_id", "bbox", "image_id").dropDuplicates(["id"])


@query(f"""
WITH r AS (SELECT ref_id, CASE WHEN len(ann_id) > 0 THEN ann_id ELSE [NULL] END AS a FROM {_REF1}), u AS (SELECT ref_id, unnest(a) AS ann FROM r)
SELECT ref_id, ann AS ann_id, x.category_id AS category_id, x.bbox[1] AS x0 FROM u LEFT JOIN {_ANN1} x ON x.id = u.ann""")
def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.refs_with_annotations(_refs(spark, sf_dir).select("ref_id", "ann_id"), _anns(spark, sf_dir)).select("ref_id", "ann_id", "category_id", F.get("bbox", F.lit(0)).alias("x0"))


@query(f"SELECT ref_id FROM {_REF1} WHERE list_has_any(category_id, [1, 2, 3]) AND split IN ('val', 'testA')")
def filter_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.filter_refs(_refs(spark, sf_dir), categories=[1, 2, 3], splits=["val", "testA"]).select("ref_id")


@query(f"SELECT DISTINCT image_id FROM {_REF1} WHERE contains(split, 'A') AND image_id IS NOT NULL")
def ref_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).where(joins.split_matches(F.col("split"), "testA") & F.col("image_id").isNotNull()).select("image_id").distinct()


@query(f"""
WITH u AS (SELECT ref_id, unnest(ann_id) AS ann FROM {_REF1})
SELECT ref_id, count(*) AS n_boxes, round(sum(x.bbox[3] * x.bbox[4]), 4) AS area FROM u JOIN {_ANN1} x ON x.id = u.ann WHERE len(x.bbox) = 4 GROUP BY ref_id""")
def ref_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = joins.refs_with_annotations(_refs(spark, sf_dir).select("ref_id", "ann_id"), _anns(spark, sf_dir)).where(F.size("bbox") == 4)
    return flat.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_boxes"), F.round(F.sum(F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3))), 4).alias("area"))


@query("SELECT c_custkey, coalesce(t, 0)::DOUBLE AS total FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_lookup_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return joins.lookup(table(spark, sf_dir, "customer").select("c_custkey"), totals, "c_custkey", "total", 0.0)


@query("SELECT DISTINCT id FROM images WHERE id IS NOT NULL AND id NOT IN (SELECT image_id FROM annotations WHERE image_id IS NOT NULL)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").where("id IS NOT NULL").select("id").distinct()
    return joins.unprocessed(images, table(spark, sf_dir, "annotations").select(F.col("image_id").alias("id")), "id")


_STEM = "regexp_replace(list_last(string_split({0}, '/')), '\\.[^.]+$', '')"


@query(f"""
WITH a AS (SELECT {_STEM.format('file_name')} AS stem, min(file_name) AS path_a FROM images WHERE file_name IS NOT NULL GROUP BY 1), b AS (SELECT {_STEM.format('image_file')} AS stem, min(image_file) AS path_b FROM mask_manifest WHERE image_file IS NOT NULL GROUP BY 1)
SELECT stem, path_a, path_b FROM a JOIN b USING (stem)""")
def stem_pair_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "images").select(F.col("file_name").alias("p")).where("p IS NOT NULL")
    return joins.pair_by_stem(a, table(spark, sf_dir, "mask_manifest").select(F.col("image_file").alias("p")).where("p IS NOT NULL"), "p")


@query("""
SELECT e.event_id, (SELECT max_by(v.value, v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.event_id <= e.event_id) AS asof_value FROM events e WHERE e.event_type = 'purchase'""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    left = e.where(F.col("event_type") == "purchase").select("event_id", "user_id")
    return joins.as_of(left, e.where(F.col("event_type") == "view"), "user_id", "event_id", "event_id", "value").select("event_id", "asof_value")



@query("SELECT event_type, (event_id // 4096)::BIGINT AS part, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; an array holds at most the ids of one range of 4,096."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.array("event_id").alias("ids"))
    return joins.merge_map_parts(e, "event_type", "event_id", "ids", 4096)


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""
WITH p AS (SELECT a.vec_id AS q_id, b.vec_id AS item_id, round({_DOT}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, item_id) AS rank FROM p) SELECT q_id, item_id, sim, rank::INT AS rank FROM r WHERE rank <= 5""")
def topk_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return joins.top_similar(e.where(F.col("vec_id") % 20 == 0), e, 5).select("q_id", "item_id", "sim", "rank")


_SQ = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _codebook(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") < 16).select(F.col("vec_id").alias("code"), F.col("embedding").alias("cvec"))


@query(f"""
WITH p AS (SELECT a.vec_id, b.vec_id AS code, round({_SQ}, 9) AS d FROM embeddings a JOIN embeddings b ON b.vec_id < 16), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, code) AS n FROM p)
SELECT vec_id, code, round(d, 6) AS dist FROM r WHERE n = 1""")
def vq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return joins.nearest_code(e, _codebook(e)).select("vec_id", "code", F.round("dist", 6).alias("dist"))


@query(f"""
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.vec_id AS code, b.embedding::DOUBLE[] AS y, round({_SQ}, 9) AS d FROM embeddings a JOIN embeddings b ON b.vec_id < 16),
f AS (SELECT vec_id, arg_min(code, (d, code)) AS c1, arg_min(list_transform(list_zip(x, y), lambda z: z[1] - z[2]), (d, code)) AS embedding FROM p GROUP BY vec_id),
q AS (SELECT a.vec_id, c1, b.vec_id AS code, round({_SQ}, 9) AS d FROM f a JOIN embeddings b ON b.vec_id < 16)
SELECT vec_id, [any_value(c1), arg_min(code, (d, code))]::BIGINT[] AS codes FROM q GROUP BY vec_id""")
def rvq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return joins.residual_codes(e, _codebook(e), 2).select("vec_id", "codes")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def normalise_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(arrays.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.get(arrays.normalise(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("""
WITH n AS (SELECT DISTINCT o_orderkey AS s FROM orders ORDER BY s DESC LIMIT 10) SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT s FROM n) OR o_orderkey = 7""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.retain(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10, 7)


@query("SELECT n_nationkey, (rid // 4)::INT AS shard FROM " + _R)
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).select("n_nationkey", balance.shard(F.col("_rid"), 25, 8).alias("shard"))



@query(f"""
SELECT id, CASE WHEN image_id IS NOT NULL THEN (row_number() OVER (PARTITION BY image_id ORDER BY bbox[1] + bbox[3] / 2, bbox[2] + bbox[4] / 2, id) - 1)::INT END AS rank FROM {_ANN1} WHERE len(bbox) = 4""")
def rank_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all images; a box without image keeps its row and has no rank."""
    return balance.rank_boxes(_anns(spark, sf_dir).where(F.size("bbox") == 4), "image_id", "bbox", "id").select("id", "rank")


@query()
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows, the same at every run."""
    return balance.exact_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 100 ELSE 1.0 END::DOUBLE AS rate FROM nation WHERE n_nationkey > 9")
def sampling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    name = F.when(key % 2 == 0, F.concat("n_name", F.lit("%"), key.cast("string"))).otherwise(F.concat("n_name", F.lit("_x")))
    return table(spark, sf_dir, "nation").where(key > 9).select("n_name", text.sampling_rate(name).alias("rate"))


@query("""SELECT * FROM (VALUES ('encode_text', 'cached'), ('encode_image', 'cached'), ('denoise', 'model'), ('decode', 'model')) AS v(unit, stage)""")
def stage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = [
        graph.Unit("encode_text", ("prompt",), ("context",), ("text_encoder",)), graph.Unit("encode_image", ("image",), ("latents",), ("vae",)),
        graph.Unit("denoise", ("context", "latents"), ("noise",), ("dit",)), graph.Unit("decode", ("noise",), ("video",), ()),
    ]
    model, cached = graph.split(units, {"dit"})
    return spark.createDataFrame([(u.name, "cached") for u in cached] + [(u.name, "model") for u in model], "unit string, stage string")
