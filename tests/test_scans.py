"""Distributed running values against plain loops, with a group that spreads over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import advantage, balance, joins, scans


def rows(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        k = rng.choice(["hot", "hot", None, "a", "b", "c%d" % rng.randint(0, 30)])
        out.append((i, k, rng.choice([1.0, -2.5, 0.25, None]), rng.choice([0.0, 0.5, 0.9, 1.0, None]), "x"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width", [1, 7])
def test_any_group_any_partition(spark, width):
    data = rows()
    want, last = {}, {}
    for i, k, a, c, _ in sorted(data):
        before = last.get(k, 0.0)
        last[k] = (a or 0.0) + (c or 0.0) * before
        want[i] = (last[k], before)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(data, "i int, k string, a double, c double, run_left string")
        got = {r.i: (r.run, r.run_before) for r in scans.running(df, ["k"], ["i"], F.col("a"), F.col("c")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "i int, k string, a double")
    assert scans.running(df, ["k"], ["i"], F.col("a")).count() == 0
    one = spark.createDataFrame([(1, "k", 2.0)], "i int, k string, a double")
    assert [tuple(r) for r in scans.running(one, ["k"], ["i"], F.col("a")).collect()] == [(1, "k", 2.0, 2.0, 0.0)]


def test_long_arrays_are_linear(spark):
    n = 32_768
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.lit(1.0)).alias("r"))
    ones = F.transform("r", lambda _: F.lit(1))
    got = df.select(advantage.discounted_returns(F.col("r"), ones, 0.5).alias("y"), advantage.generalised_advantages(F.col("r"), F.col("r"), ones, 1.0, 1.0).alias("a")).first()
    assert len(got.y) == n and got.y[0] == pytest.approx(2.0) and got.y[-1] == 1.0 and got.a[0] == pytest.approx(n - 1)


def test_masked_advantages(spark):
    rng = random.Random(9)
    for _ in range(6):
        r, v, m = ([rng.choice([0.5, -1.0, 2.0]) for _ in range(9)] for _ in range(3))
        m = [rng.randint(0, 1) for _ in m]
        want, nxt, last = [0.0] * 9, 0.0, 0.0
        for t in reversed(range(9)):
            if m[t]:
                last, nxt = r[t] + 0.9 * nxt - v[t] + 0.9 * 0.8 * last, v[t]
            want[t] = last
        arr = lambda x: F.array(*[F.lit(y) for y in x])
        got = spark.range(1).select(advantage.generalised_advantages(arr(r), arr(v), arr(m), 0.9, 0.8).alias("a")).first().a
        assert list(got) == pytest.approx(want)
        df = spark.createDataFrame([("g", t, r[t], v[t], m[t]) for t in range(9)], "g string, t int, r double, v double, m int")
        rows_ = {x.t: x.advantage for x in advantage.gae_rows(df, F.col("r"), F.col("v"), F.col("m"), "g", F.col("t"), gamma=0.9, lam=0.8).collect()}
        assert [rows_[t] for t in range(9)] == pytest.approx(want)


def test_last_known_value(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 7.0), ("a", 5, 8.0), ("b", 10, 1.0), ("a", 4, None), (None, 1, 6.0)], "k string, t int, v double")
    assert {r.id: r.asof_v for r in joins.as_of(left, right, "k", "t", "t", "v").collect()} == {1: 8.0, 2: None, 3: None, 4: 6.0}


def test_box_orders(spark):
    df = spark.createDataFrame([(1, 7, [0.0, 5.0, 2.0, 2.0]), (2, 7, [3.0, 0.0, 2.0, 2.0]), (3, 7, [1.0, 0.0, 9.0, 2.0])], "id int, image int, box array<double>")
    order = lambda m: [r.id for r in balance.rank_boxes(df, "image", "box", "id", m).orderBy("rank").collect()]
    assert order("ltr-ttb") == [1, 2, 3] and order("ttb-ltr") == [2, 3, 1] and order("tlbr") == [3, 2, 1]
