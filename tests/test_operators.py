import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, balance, batch, joins
from millrace.plans import graph
from millrace.sources import io
from millrace.streaming import incremental


@pytest.fixture(scope="module")
def rows(spark):
    return batch.row_ids(spark.range(10).withColumnRenamed("id", "v"), "v")


def values(df, *order):
    return [r.v for r in df.orderBy(*(order or ("_rid",))).collect()]


def test_positions(spark, rows):
    assert [(r._rid, r.v) for r in rows.orderBy("_rid").collect()] == [(i, i) for i in range(10)]
    assert batch.row_ids(spark.range(0).withColumnRenamed("id", "v"), "v").count() == 0


def test_batch_round_trips(rows):
    inverse = rows.select(F.col("_rid").alias("idx"), (9 - F.col("_rid")).alias("pos"))
    assert values(batch.index_select(rows, inverse)) == list(range(9, -1, -1))
    assert values(batch.index_select(batch.index_select(rows, inverse), inverse)) == list(range(10))
    padded = batch.pad_to_divisor(rows, 10, 4)
    assert values(padded) == [*range(10), 0, 1] and values(batch.unpad(padded, 12, 2)) == list(range(10))
    assert values(batch.pad_to_divisor(batch.slice_rows(rows, 0, 2), 2, 7)) == [0, 1, 0, 1, 0, 1, 0]
    parts = [batch.split(rows, 3).where(F.col("part") == p).drop("part") for p in range(4)]
    assert values(batch.concat(parts)) == list(range(10))
    with pytest.raises(ValueError):
        batch.chunk(rows, 3, 10)


def test_column_union(rows):
    other = rows.select("_rid", "v", (F.col("v") * 2).alias("w"))
    assert batch.column_union(rows, other).columns == ["_rid", "v", "w"]
    with pytest.raises(Exception, match="differs"):
        batch.column_union(rows, rows.withColumn("v", F.col("v") + 1)).collect()
    popped, rest = batch.pop(rows, "v", "absent")
    assert popped.columns == ["_rid", "v"] and rest.columns == ["_rid"]


def test_pipeline_operator(spark):
    plus = batch.Op(lambda c: c + 1)
    both = plus >> plus
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    r = batch.apply_to(df, ["a", "b", "c"], both, {"b": plus.over_list()}).first()
    assert (r.a, r.b) == (3, [2, 3]) and len(plus.steps) == 1


def test_joins(spark):
    ids = spark.createDataFrame([(0, 5), (1, 3), (2, 5)], "pos int, id int")
    df = spark.createDataFrame([(3, "c"), (5, "e")], "k int, x string")
    assert [r.x for r in joins.by_ids(df, "k", ids).orderBy("pos").collect()] == ["e", "c", "e"]
    with pytest.raises(Exception, match="no row"):
        joins.by_ids(df, "k", spark.createDataFrame([(0, 9)], "pos int, id int")).collect()


def test_nearest_code_blocks_agree(spark, monkeypatch):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "vec_id bigint, embedding array<double>")
    book = e.where("vec_id < 9").select(F.col("vec_id").alias("code"), F.col("embedding").alias("cvec"))
    small = {(r.vec_id, r.code) for r in joins.nearest_code(e, book).collect()}
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", -1)
    assert {(r.vec_id, r.code) for r in joins.nearest_code(e, book).collect()} == small


def test_balance_and_samples(spark):
    df = spark.createDataFrame([(i, 1 + i * i % 97) for i in range(500)], "k bigint, size bigint")
    out = balance.balance(df, "size", 4, "k", block=100)
    r = balance.imbalance(out, "part", "size").first()
    assert out.count() == 500 and r["diff"] < 0.02 * r["most"]
    a, b = (sorted(x.k for x in balance.exact_sample(df, 17, "k", seed=3).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 17


def test_keep_last_and_means(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, 7)], "k string, o int, v int")
    assert {(r.k, r.o, r.v) for r in aggregates.keep_last(df, ["k"], ["o"]).collect()} == {("a", 2, 5), ("b", 1, 7)}
    tree = spark.createDataFrame([("A", "x", "p", 0.0), ("A", "x", "q", 60.0), ("A", "y", "r", None)], "l1 string, l2 string, l3 string, s double")
    assert aggregates.mean_of_means(tree, "s", "l1", "l2").first().s == 30.0


def test_graph_split():
    U = graph.Unit
    units = [U("a", ("p",), ("x",)), U("m", ("x",), ("y",), ("dit",)), U("b", ("q",), ("z",)), U("c", ("y", "z"), ("w",))]
    model, cached = graph.split(units, {"dit"})
    assert [u.name for u in model] == ["m", "c"] and [u.name for u in cached] == ["a", "b"]
    assert graph.needed_columns(cached, model, ["p", "q", "x", "z"]) == ["x", "z"]
    updating = [U("m", ("s",), ("s",), ("dit",)), U("later", ("t",), ("s",))]
    assert [u.name for u in graph.split(updating, {"dit"})[0]] == ["m", "later"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"image": "1.jpg", "prompt": "p"}, {"image": "2.jpg", "prompt": "q"}]))
    (tmp_path / "b.jsonl").write_text('{"image": "1.jpg"}\n\n{"image": "2.jpg", "prompt": "q"}\n')
    (tmp_path / "c.csv").write_text('image,prompt\n1.jpg,"a\nb"\n2.jpg,3\n')
    assert [io.read_metadata(spark, str(tmp_path / n)).count() for n in ("a.json", "b.jsonl", "c.csv")] == [2, 2, 2]
    catalog = {"one": {"path": str(tmp_path / "a.json")}, "two": {"path": str(tmp_path / "b.jsonl")}}
    df = io.read_catalog(spark, "one,two%200", catalog, "image")
    assert df.groupBy("data_path").count().orderBy("data_path").collect()[1]["count"] == 4
    with pytest.raises(ValueError):
        io.catalog_entry("three%10", catalog)
    out = str(tmp_path / "out")
    base = spark.range(5)
    assert io.resume_write(base, out, "id") == 5 and io.resume_write(spark.range(8), out, "id") == 3
    io.write_shards(base, str(tmp_path / "shards"), 2)
    assert sorted(r.ext for r in io.list_files(spark, str(tmp_path / "shards"), "json").collect())[0] == "json"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, i % 3) for i in range(30)], "item bigint, k int").write.parquet(src)
    stream = incremental.choose_without_repeat(incremental.read_stream(spark, src, "item bigint, k int"), "k", "item")
    got = []
    incremental.for_each_batch(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in got) == [0, 1, 2] and all(r.chosen % 3 == r.k for r in got)
    full = incremental.fill_batches(iter([spark.range(3), spark.range(3, 9)]), lambda d: d.where("id % 2 = 0"), 4, 5, "id")
    assert [r.id for r in full.collect()] == [0, 2, 4, 6]
    with pytest.raises(ValueError):
        incremental.fill_batches(iter([spark.range(1)]), lambda d: d, 4, 1, "id")
