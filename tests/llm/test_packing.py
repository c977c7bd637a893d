import datetime as dt
import random
from collections import defaultdict

from millrace.llm import packing

T0 = dt.datetime(2024, 1, 1)
DDL = "conv_id bigint, input_ids array<bigint>, ingested_at timestamp, length string, bin string, container string"


def pack(spark, sizes, caps, **kw):
    rows = [(n, None if s is None else list(range(s)), T0, "", "", "") for n, s in enumerate(sizes)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, [1], T0, "", "", "")], DDL)
    return packing.pack(df, spark.createDataFrame(caps, "limit_id int, capacity int"), **kw).collect()


def test_every_id_once_and_full(spark):
    rng = random.Random(0)
    sizes = [None, 0, *(min(400, int(rng.paretovariate(1.1) * 4)) for _ in range(600)), 250, 100]
    out = pack(spark, sizes, [(1, 100), (2, 64)], island_items=200)
    for limit, cap in ((1, 100), (2, 64)):
        mine = [r for r in out if r.limit_id == limit]
        fill, of = defaultdict(int), defaultdict(list)
        for r in mine:
            fill[r.container] += r.length
            of[r.conv_id].append((r.start, r.length))
        assert max(fill.values()) <= cap
        for n, s in enumerate(sizes):
            parts = sorted(of.get(n, []))
            assert sum(x for _, x in parts) == (s or 0)
            assert [a for a, _ in parts] == [k * cap for k in range(len(parts))]
            assert len(parts) <= 1 or s > cap
        least = -(-sum(s or 0 for s in sizes) // cap)
        assert len(fill) <= least * 1.02 + 1


def test_crossover_keeps_items():
    rng = random.Random(1)
    size = [rng.randint(1, 60) for _ in range(80)]
    order = sorted(range(80), key=lambda i: -size[i])
    a, b = packing.best_fit(order, size, 100, []), packing.best_fit(order[::-1], size, 100, [])
    for bins in (packing._crossover(a, b, size, 100, rng), packing._mutate(a, size, 100, rng), packing.evolve(size, 100, b, 3)):
        assert sorted(i for x in bins for i in x) == list(range(80)) and all(sum(size[i] for i in x) <= 100 for x in bins)
    assert len(packing.evolve(size, 100, b, 3)) <= min(len(a), len(b))


def test_nothing_to_pack(spark):
    assert pack(spark, [None, 0], [(1, 10)]) == [] or all(r.conv_id is not None for r in pack(spark, [None, 0], [(1, 10)]))
    assert pack(spark, [5, 6], [(1, None), (2, 0)]) == []
