import datetime as dt
import random

from millrace.operators.orphans import Link, apply_batch, current_orphans, orphan_report, orphans

D = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
SRC = "sid bigint, ref array<bigint>, ingested_at timestamp, state string, target string, alive string, salt int"
DST = "id bigint, ingested_at timestamp, is_deleted boolean, refs string"


def run(spark, src, dst):
    s = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in src], SRC)
    d = spark.createDataFrame([(*r, "x") for r in dst], DST)
    return orphans([Link("s", s, "sid", "ref", "d", d, "id", none=-1)])


def test_states(spark):
    src = [(1, [1], D(5)), (2, [2], D(5)), (3, [3], D(5)), (4, [4, 4, 9], D(5)), (5, [-1], D(5)), (6, None, D(5)), (7, [], D(5)), (8, [5], None), (1, [1], D(9)), (None, [9], D(1))]
    dst = [(1, D(1), False), (2, D(1), False), (2, D(2), True), (3, D(6), None), (4, D(1), True), (4, D(3), False), (4, D(3), False), (5, D(8), False), (None, D(1), False)]
    out = run(spark, src, dst)
    assert sorted((r.src_id, r.target, r.state) for r in out.collect()) == [(2, "2", "deleted"), (3, "3", "late"), (4, "9", "missing")]
    assert {(r.state, r.period, r.n_orphans) for r in orphan_report(out).collect()} == {("deleted", "2024-01", 1), ("late", "2024-01", 1), ("missing", "2024-01", 1)}


def test_empty(spark):
    assert run(spark, [], []).count() == 0
    assert [r.state for r in run(spark, [(1, [7], D(0))], []).collect()] == ["missing"]


def test_brute_force_with_hot_key(spark):
    rng = random.Random(1)
    src = [(i, [0] if rng.random() < 0.4 else [rng.randint(1, 30)], D(rng.randint(0, 9))) for i in range(400)]
    dst = [(rng.randint(1, 30), D(rng.randint(0, 9)), rng.choice([True, False, None])) for _ in range(60)]
    dst = list({(k, t): (k, t, g) for k, t, g in dst}.values())
    want = []
    for i, (k,), at in src:
        mine = sorted((t, bool(g)) for kk, t, g in dst if kk == k)
        state = "missing" if not mine else "deleted" if mine[-1][1] else "late" if mine[0][0] > at else None
        if state:
            want.append((i, str(k), state))
    assert sorted((r.src_id, r.target, r.state) for r in run(spark, src, dst).collect()) == sorted(want)


def test_batches_in_any_division_leave_the_same_state(spark):
    rng = random.Random(7)
    src = [(rng.randint(0, 40), [rng.choice([-1, 0, *range(12)]) for _ in range(rng.randint(0, 3))], D(rng.randint(0, 20))) for _ in range(120)]
    src = list({(k, t): (k, v, t) for k, v, t in src}.values())
    dst = list({(k, t): (k, t, g) for k, t, g in ((rng.randint(0, 9), D(rng.randint(0, 20)), rng.choice([True, False, None])) for _ in range(40))}.values())
    links = lambda a, b: [Link("s", spark.createDataFrame([(*r, "a", "b", "c", 1) for r in a], SRC), "sid", "ref", "d", spark.createDataFrame([(*r, "x") for r in b], DST), "id", none=-1)]
    rows = lambda df: sorted(map(str, df.collect()))
    whole = apply_batch(None, links(src, dst))
    want, keys = rows(current_orphans(whole)), rows(whole.keys.select("target", "refs", "alive", "newest", "first_at"))
    for parts in (2, 3):
        rng.shuffle(src)
        rng.shuffle(dst)
        state = None
        for k in range(parts):
            state = apply_batch(state, links(src[k::parts], dst[k::parts]))
        assert rows(current_orphans(state)) == want
        # a key that lost its last reference stays with a count of zero
        assert [r for r in rows(state.keys.select("target", "refs", "alive", "newest", "first_at")) if "refs=0" not in r or "newest=None" not in r] == keys


def test_counts_go_down(spark):
    link = lambda a, b: [Link("s", spark.createDataFrame([(*r, "a", "b", "c", 1) for r in a], SRC), "sid", "ref", "d", spark.createDataFrame([(*r, "x") for r in b], DST), "id", none=-1)]
    counts = lambda s: {r.target: (r.refs, r.alive) for r in s.keys.collect()}
    one = apply_batch(None, link([(1, [1, 2], D(5))], [(1, D(1), False), (2, D(1), False)]))
    assert counts(one) == {"1": (1, 1), "2": (1, 1)}
    two = apply_batch(one, link([(1, [2], D(4))], [(1, D(0), False), (2, D(2), True)]))  # an earlier row names 2 only; 2 is deleted
    assert counts(two) == {"1": (0, 1), "2": (1, 0)} and [r.state for r in current_orphans(two).collect()] == ["deleted"]
    assert counts(apply_batch(two, link([], [(2, D(3), None)]))) == {"1": (0, 1), "2": (1, 1)}
