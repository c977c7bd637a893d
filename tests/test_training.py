"""Operators of the training queries whose results SQL does not give: brute force and small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, media
from millrace.operators import advantage, aggregates, balance, batch, joins, tensors
from millrace.queries_core import QUERIES
from millrace.sources import io
from tests.conftest import DATA


def test_dynamic_batches_cover_every_row(spark):
    df = spark.createDataFrame([(i, (i * 37) % 90 + 1) for i in range(300)], "k int, size int")
    out = balance.dynamic_batches(df, "size", 200, "k", block=64).collect()
    assert sorted(r.k for r in out) == list(range(300))
    loads = {}
    for r in out:
        loads.setdefault((r.batch, r.micro), []).append(r.size)
    assert max(sum(v) for v in loads.values()) <= 200 * 1.3
    for b in {k[0] for k in loads}:
        work = [sum(x * x for x in loads[b, m]) for m in sorted(m for bb, m in loads if bb == b)]
        assert work == sorted(work, reverse=True)
    with pytest.raises(Exception, match="larger than"):
        balance.dynamic_batches(df, "size", 10, "k").collect()


def test_files_of_tensors(spark):
    t = spark.createDataFrame([(0, "module.a", [1], [1.0]), (0, "module.b", [1], [2.0]), (1, "a", [1], [9.0])], "file int, name string, shape array<int>, data array<double>")
    flat = tensors.unwrap_single(t, "module", "state_dict")
    assert {(r.file, r.name) for r in flat.collect()} == {(0, "a"), (0, "b"), (1, "a")}
    assert {r.name: r.data for r in tensors.load_files(flat).collect()} == {"a": [9.0], "b": [2.0]}
    names = spark.createDataFrame([("x",), ("b",)], "name string")
    assert {r.name: r.data for r in tensors.find(flat, names, {"x": "a"}).collect()} == {"x": [9.0], "b": [2.0]}
    with pytest.raises(Exception, match="no tensor"):
        tensors.find(flat, spark.createDataFrame([("zz",)], "name string")).collect()


def test_low_rank_factors(spark):
    a0, a1, b0, b1 = np.arange(6.0).reshape(2, 3), np.ones((1, 3)), np.arange(8.0).reshape(4, 2), np.full((4, 1), 5.0)
    rows = [(f, f"x.lora_{s}.weight", list(m.shape), m.ravel().tolist()) for f, s, m in ((0, "A", a0), (1, "A", a1), (0, "B", b0), (1, "B", b1))] + [(1, "y.lora_A.weight", [1, 1], [1.0])]
    df = spark.createDataFrame(rows, "file int, name string, shape array<int>, data array<double>")
    got = {r.name: np.array(r.data).reshape(r["shape"]) for r in tensors.merge_low_rank(df, 2.0).collect()}
    assert set(got) == {"x.lora_A.weight", "x.lora_B.weight"}
    assert np.allclose(got["x.lora_A.weight"], np.vstack([a0, a1]) * 2) and np.allclose(got["x.lora_B.weight"], np.hstack([b0, b1]))


def test_caches(spark):
    df = spark.createDataFrame([(0, "kv_cache", "k1", [1.0]), (1, "kv_cache", "k1", [2.0]), (1, "kv_cache", "k2", [3.0]), (0, "size", "", [7.0]), (1, "size", "", [8.0])], "template int, param string, key string, value array<double>")
    assert {(r.param, r.key): r.value for r in tensors.merge_caches(df).collect()} == {("kv_cache", "k1"): [1.0, 2.0], ("kv_cache", "k2"): [3.0], ("size", ""): [7.0]}


def test_media(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(media.grouped_frames(F.lit(n), 17, 5)) for n in (22, 38, 39, 120)] == [22, 22, 39, 107]
    with pytest.raises(Exception, match="fewer"):
        one(media.grouped_frames(F.lit(10), 17, 5))
    wave = F.array(*[F.lit(float(x)) for x in range(10)])
    assert one(media.cut(wave, media.sample_range(F.lit(2.0), 1.0, 2.0, F.lit(10)))) == [2.0, 3.0, 4.0, 5.0]
    assert one(media.cut(wave, media.sample_range(F.lit(2.0), 4.0, None, F.lit(10)))) == [8.0, 9.0]
    assert one(media.resample(wave, F.lit(10.0), 20))[:4] == [0.0, 0.5, 1.0, 1.5] and one(media.resample(F.array().cast("array<double>"), F.lit(1.0), 2)) == []
    assert one(media.halve(F.array(*[F.lit(x) for x in range(16)]), F.lit(4), F.lit(4))) == [0, 2, 8, 10]
    assert one(joins.nearest_index(F.lit(3), 10.0, F.lit(30.0), F.lit(10))) == 9 and one(joins.nearest_index(F.lit(4), 10.0, F.lit(30.0), F.lit(10))) is None


def test_batches(spark):
    df = batch.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}, "a int, b string")
    assert [tuple(r) for r in df.orderBy("_rid").collect()] == [(0, 1, "x"), (1, 2, "y")]
    with pytest.raises(ValueError):
        batch.from_columns(spark, {"a": [1], "b": []}, "a int, b string")
    odd = spark.createDataFrame([(1, [1], [2]), (2, [1, 2], [1])], "k int, a array<int>, b array<int>")
    assert [r.k for r in batch.check_lengths(odd, "a", "b").collect()] == [2]
    assert batch.same_rows(df, df) and not batch.same_rows(df, df.limit(1))
    seq = spark.createDataFrame([(1, [1, 2, 3, 4, 5], 5), (2, [9], 1)], "k int, s array<int>, n int")
    parts = batch.sequence_parts(seq, "s", 2, F.lit(0))
    assert {(r.k, r.part): r.s for r in parts.collect()} == {(1, 0): [1, 2, 3], (1, 1): [4, 5, 0], (2, 0): [9], (2, 1): [0]}
    assert {r.k: r.s for r in batch.join_parts(parts, "k", "s", "n").collect()} == {1: [1, 2, 3, 4, 5], 2: [9]}
    assert batch.route_by_type(df, "a", {"integer": batch.to_text()}).schema["a"].dataType.typeName() == "string"
    with pytest.raises(ValueError):
        batch.route_by_type(df, "b", {})


def test_maps_and_masked_variance(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    assert spark.range(1).select(joins.merge_checked(m(a="1", b="2"), m(b="2", c="3")).alias("x")).first().x == {"a": "1", "b": "2", "c": "3"}
    with pytest.raises(Exception, match="differ"):
        spark.range(1).select(joins.merge_checked(m(a="1"), m(a="2")).alias("x")).collect()
    df = spark.createDataFrame([(1.0, 0), (5.0, 1), (2.0, 0)], "v double, m int")
    assert df.agg(aggregates.masked_var(F.col("v"), F.col("m")).alias("x")).first().x == pytest.approx(0.0)


def test_similar_vectors_by_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 5)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    got = {(r.q_id, r["rank"]): r.item_id for r in joins.top_similar(df.where("vec_id < 9"), df, 3, block=4, chunk=16).collect()}
    sims = np.round(x[:9] @ x.T, 6)
    for q in range(9):
        order = [i for i in np.lexsort((np.arange(70), -sims[q])) if i != q][:3]
        assert [got[q, k] for k in (1, 2, 3)] == order


def test_dead_codes(spark):
    book = spark.createDataFrame([(0, 5.0, [1.0, 1.0]), (1, 0.1, [2.0, 2.0])], "code int, n double, mean array<double>")
    vectors = spark.createDataFrame([([7.0, 8.0],), (None,)], "v array<double>")
    assert {r.code: r["mean"] for r in aggregates.restart_dead(book, vectors, "v", 1.0).collect()} == {0: [1.0, 1.0], 1: [7.0, 8.0]}


def test_estimators_share_one_form(spark):
    df = spark.createDataFrame([(1, "g", 0.5, [1.0, 0.0], [0.1, 0.2], [1, 1]), (2, "g", 0.0, [0.0, 2.0], [0.0, 0.1], [1, 1]), (3, "g", 0.2, [0.5, 9.0], [0.0, 0.0], [1, 0])], "row int, uid string, baseline double, rewards array<double>, values array<double>, mask array<int>")
    for name, estimate in advantage.ESTIMATORS.items():
        out = {r.row: r for r in estimate(df).collect()}
        assert len(out) == 3 and all(len(r.advantages) == len(r.returns) == 2 for r in out.values()), name
    best = {r.row: r.advantages[0] for r in advantage.ESTIMATORS["grpo_passk"](df).collect()}
    sd = np.std([1.0, 2.0, 9.5], ddof=1)
    assert best[3] == pytest.approx((9.5 - 2.0) / (sd + 1e-6)) and best[1] == 1.0
    with pytest.raises(Exception, match="one sequence"):
        advantage.ESTIMATORS["grpo"](df.limit(1)).collect()
    with pytest.raises(NotImplementedError):
        advantage.ESTIMATORS["unknown"]


def test_parameter_headers(spark, tmp_path):
    import json

    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {"a": "b"}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + b"\0" * 24)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.name, r.dtype, r["shape"]) for r in io.read_parameter_names(files).collect()] == [("w", "F32", [2, 3])]
    assert io.read_file_metadata(files).first().metadata == {"a": "b"}
    assert bytes(spark.range(1).select(io.decode_data_uri(F.lit("data:image/png;base64,QUJD")).alias("x")).first().x) == b"ABC"


def test_rewards_of_tables(spark):
    rows = QUERIES["reward_scores"](spark, str(DATA)).collect()
    assert rows and all(1.0 <= r.overall <= 3.0 and r.overall == pytest.approx(r.accuracy + r.no_repeat + 1.0) for r in rows)


def test_positions_of_media(spark):
    v, i = arrays.VIDEO_TOKEN, arrays.IMAGE_TOKEN
    ids = [1, 2, *[i] * 2, 3, *[v] * 12, 4, 5, i]
    grid = lambda *g: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(h).alias("h"), F.lit(w).alias("w")) for t, h, w in g])
    a = F.array(*[F.lit(x).cast("bigint") for x in ids])
    got = spark.range(1).select(arrays.grid_positions(arrays.media_segments(a, grid((1, 2, 4)), grid((3, 4, 4)), F.array(F.lit(25.0))), timed=True).alias("p")).first().p
    p = [tuple(x) for x in got]
    assert len(p) == len(ids) and p[:2] == [(0, 0, 0), (1, 1, 1)] and p[2:4] == [(2, 2, 2), (2, 2, 3)] and p[4] == (4, 4, 4)
    assert p[5:9] == [(5, 5, 5), (5, 5, 6), (5, 6, 5), (5, 6, 6)] and p[9] == (55, 5, 5) and p[13] == (105, 5, 5)
    assert p[17:] == [(106, 106, 106), (107, 107, 107), (108, 108, 108)]  # a placeholder without a grid is text


def test_bench_totals(spark):
    df = spark.createDataFrame([(1, "Quality", '{"Realism": {"Noise": {"score": 1}, "Logic": {"score": 2}}}'), (1, "Alignment", '{"Color": {"score": 0}}'), (2, "Quality", "no json"), (3, "Quality", '{"A": {"B": 2, "C": "N/A"}}')], "s int, d string, t string")
    rows, total = aggregates.bench_scores(df, "s", "d", "t", {"Noise": "Detail"}, {})
    assert {(r.s, r.l2, r.l3): r.score for r in rows.collect()} == {(1, "Detail", "Noise"): 60.0, (1, "Realism", "Logic"): 100.0, (1, "Color", "Color"): 0.0, (3, "A", "B"): 100.0, (3, "A", "C"): None}
    assert {r.s: r.total for r in total.collect()} == {1: 40.0, 3: 100.0}


def test_rewards_of_a_batch(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "k int, r string")
    out = batch.batch_rewards(df, lambda rs: [{"overall": float(len(r["r"])), "n": len(rs)} for r in rs], ["r"], "overall double, n bigint", "k")
    assert {r.k: r.overall for r in out.collect()} == {i: float(i) for i in range(5)}
    with pytest.raises(Exception, match="scores for"):
        batch.batch_rewards(df, lambda rs: [], ["r"], "overall double", "k").collect()


def test_stand_ins_and_steps(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "_rid bigint, bad boolean")
    got = {r._rid: r.source for r in batch.stand_in(df, F.col("bad"), 30).collect()}
    assert all((got[i] == i) != (i % 3 == 0) and 0 <= got[i] < 30 for i in got)
    assert io.latest_step(spark, str(tmp_path / "none")) is None
    for n in (5, 40, 100):
        (tmp_path / f"global_step_{n}").mkdir()
    (tmp_path / "global_step_x").mkdir()
    path, step = io.latest_step(spark, str(tmp_path))
    assert step == 100 and path.endswith("global_step_100")


def test_similarity_matrix(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0]), (3, None)], "k int, v array<double>")
    got = {r.k: r.sims for r in joins.similarity_matrix(df, df.where("k = 2"), "k", "v").collect()}
    assert got[1] == pytest.approx([0.8]) and got[2] == pytest.approx([1.0]) and got[3] is None
    assert joins.paired_similarity(df.where("k = 1").withColumn("w", F.col("v")), "v", "w").first().sim == pytest.approx(1.0)
