"""Queries over whole tables: nothing is left out by a filter, a prefix or a constant limit."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.operators import aggregates, balance, joins
from millrace.queries_core import QUERIES
from tests.conftest import DATA


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_merge_maps_holds_every_event(spark):
    ids = [i for r in QUERIES["merge_maps"](spark, str(DATA)).collect() for i in r.ids]
    assert sorted(ids) == sorted(r.event_id for r in rows_of(spark, "events").select("event_id").collect())
    df = spark.createDataFrame([("a", i, [i, -i]) for i in (9, 3, 4, 12)], "k string, o bigint, v array<int>")
    assert {(r.k, r.part): r.v for r in joins.merge_map_parts(df, "k", "o", "v", 8).collect()} == {("a", 0): [3, -3, 4, -4], ("a", 1): [9, -9, 12, -12]}


def test_rank_boxes_holds_every_image(spark):
    anns = rows_of(spark, "annotations").where(F.size("bbox") == 4).where("id IS NOT NULL").select("id").distinct()
    assert QUERIES["rank_boxes"](spark, str(DATA)).select("id").distinct().count() == anns.count()
    df = spark.createDataFrame([(1, 7, [9.0, 0.0, 2.0, 2.0]), (2, 7, [0.0, 0.0, 2.0, 2.0]), (3, None, [5.0] * 4), (4, None, [1.0] * 4)], "id bigint, image bigint, box array<double>")
    assert {(r.id, r["rank"]) for r in balance.rank_boxes(df, "image", "box", "id").collect()} == {(1, 1), (2, 0), (3, None), (4, None)}


def test_interleave_ranks_ends_with_the_table(spark, tmp_path):
    spark.range(120).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted((r.s_suppkey, r.pos) for r in QUERIES["interleave_ranks"](spark, str(tmp_path)).collect()) == [(i, i) for i in range(120)]


def test_mask_areas_of_every_shape(spark, tmp_path):
    mask, ring = {"size": [2, 5], "counts": [1, 2, 3, 4]}, [1, 1, 4, 1, 4, 3]
    shapes = [
        (json.dumps([mask, {"size": [2, 5], "counts": [2, 2, 6]}]), None), (json.dumps(mask), None), (json.dumps([ring, mask]), None), (json.dumps(json.dumps([mask])), None),
        (json.dumps({"size": [2, 5]}), "[3, 5, 2]"), (json.dumps({"size": [2, 5], "counts": "[0, 1, 9]"}), None), (json.dumps({"size": [2, 5], "counts": [10]}), None), (json.dumps([ring]), None),
    ]
    df = spark.createDataFrame([(i, s, c, dt.datetime(2024, 1, 1)) for i, (s, c) in enumerate(shapes)], "id bigint, segmentation string, counts string, ingested_at timestamp")
    df.write.parquet(str(tmp_path / "annotations.parquet"))
    got = {(r.parent_id, r.child_pos): r.area for r in QUERIES["mask_areas"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 6, (0, 1): 2, (1, 0): 6, (2, 1): 6, (3, 0): 6, (4, 0): 5, (5, 0): 1, (6, 0): 0}
    union = {r.parent_id: r.area for r in QUERIES["mask_union_areas"](spark, str(tmp_path)).collect()}
    assert union == {0: 7, 1: 6, 2: 6, 3: 6, 4: 5, 5: 1, 6: 0}  # of 0: pixels 1-2 and 6-9 with 2-3


def test_sequences_are_taken(spark, tmp_path):
    ids = [[3, 1, 1, 3] * 2_000 + [151655, 3, 3], [1], [3] * 30 + [151655] + [1] * 70]
    spark.createDataFrame([(i, None, None, x) for i, x in enumerate(ids)], "conv_id bigint, image string, conversations string, input_ids array<bigint>").write.parquet(str(tmp_path / "conversations.parquet"))
    of = lambda name, c: {r.conv_id: r[c] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    bits = [[int(x % 3 == 0) for x in s] for s in ids]
    runs = of("rle_encode", "runs")
    assert {i: [b for k, n in enumerate(r) for b in [k % 2] * n] for i, r in runs.items()} == dict(enumerate(bits)) and all(0 not in r[1:] for r in runs.values())
    ends = [s.index(151655) if 151655 in s else len(s) for s in ids]
    assert of("response_mask", "mask") == {i: [int(k <= ends[i]) for k in range(len(s))] for i, s in enumerate(ids)}
    odd = [(sum(x & (k % 2) for k, x in enumerate(b)), sum(x | (k % 2) for k, x in enumerate(b))) for b in bits]
    assert of("mask_iou", "iou") == {i: round(a / u, 6) if u else 0.0 for i, (a, u) in enumerate(odd)}


def test_run_lengths_edges(spark):
    df = spark.createDataFrame([(0, []), (1, [0]), (2, [1]), (3, [1, 1, 0]), (4, None)], "i int, b array<int>")
    assert {r.i: r.x for r in df.select("i", arrays.run_lengths(F.col("b")).alias("x")).collect()} == {0: [0], 1: [1], 2: [0, 1], 3: [0, 2, 1], 4: None}


def test_embeddings_have_every_dimension(spark):
    e = rows_of(spark, "embeddings")
    d = len(e.first().embedding)
    got = {(r.i, r.j): r.cov for r in QUERIES["covariance_stats"](spark, str(DATA)).collect()}
    cov = np.cov(np.array([r.embedding for r in e.collect()], dtype=float).T)
    assert len(got) == d * (d + 1) // 2 and all(abs(cov[k] - v) < 1e-6 for k, v in got.items())
    codes = QUERIES["codebook_update"](spark, str(DATA))
    assert codes.count() == d * e.select("label").distinct().count()


def test_covariance_far_from_zero(spark):
    x = np.random.default_rng(5).normal(1e7, 1.0, (500, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(7)
    got = {(r.i, r.j): r.cov for r in aggregates.feature_statistics(df, "v").collect()}
    assert all(abs(np.cov(x.T)[k] - v) < 1e-6 for k, v in got.items())
