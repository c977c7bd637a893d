import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import arrays, masks, rewards, text
from millrace.operators import advantage, aggregates, balance


def one(spark, **columns):
    return spark.createDataFrame([(1,)], "k int").select(*[c.alias(n) for n, c in columns.items()]).first()


def ints(*v):
    return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")


def test_golden_rows(spark):
    r = one(
        spark, eos=arrays.response_mask(ints(0, 0, 2, 4, 3, 5, 1, 0, 0), [1]),
        many=rewards.repair(F.lit("<|mt_start|><|mt_0186|><|mt_0410|><|mt_0186|><|mt_end|>")), few=rewards.repair(F.lit("<|mt_start|><|mt_0198|><|mt_end|>")), none=rewards.repair(F.lit("<|mt_start|><|mt_0198|>")),
        right=rewards.repair(F.lit("<|mt_start|><|mt_0044|><|mt_0442|><|mt_end|>")), path=text.absolute_path(F.lit("image.jpg"), "/data"), rate=text.sampling_rate(F.lit("llava%30")),
        frames=F.transform(ints(0, 1, 3, 6, 80, 100), lambda t: arrays.frame_count(t, 81, 4, 1)),
    )
    assert r.eos == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert r.many == "<|mt_start|><|mt_0186|><|mt_0410|><|mt_end|>"
    assert r.few == r.none == "<|mt_start|><|mt_0198|><|mt_9999|><|mt_end|>"
    assert r.right == "<|mt_start|><|mt_0044|><|mt_0442|><|mt_end|>"
    assert (r.path, r.rate, list(r.frames)) == ("/data/image.jpg", 0.3, [0, 1, 1, 5, 77, 81])


def test_rewards(spark):
    a, b = "<|mt_start|><|mt_0001|><|mt_0300|><|mt_end|>", "<|mt_start|><|mt_0001|><|mt_0301|><|mt_end|>"
    tri = '{"subject": {"mask_2d": "%s", "label": "cup"}, "predicate": "on", "object": {"mask_2d": "%s", "label": "table"}}'
    swapped = '{"subject": {"label": "cup", "mask_2d": "%s"}, "predicate": "on", "object": {"label": "table", "mask_2d": "%s"}}'
    r = one(
        spark, same=rewards.mask_token_reward(F.lit(a + b), F.lit(a + b)), half=rewards.mask_token_reward(F.lit(a), F.lit(b)), none=rewards.mask_token_reward(F.lit("x"), F.lit("y")),
        null=rewards.mask_token_reward(F.lit(None).cast("string"), F.lit(a)), often=rewards.non_repeat_reward(F.lit(a * 4)), fmt=rewards.format_reward(F.lit("<think>a\nb</think> <answer>c</answer>")),
        graph=rewards.scene_graph_reward(F.lit(tri % (a, b)), F.lit(tri % (a, b))), graph2=rewards.scene_graph_reward(F.lit(tri % (a, b)), F.lit(tri % (b, b))),
        gcg=rewards.gcg_phrase_reward(F.lit(f"<|object_ref_start|>Red  Cup <|object_ref_end|> {a}"), F.lit(f"<|object_ref_start|>red cup<|object_ref_end|>{b}")),
        score=rewards.score(F.lit("reasonseg"), F.lit(f"<think>t</think><answer>{a}</answer>"), F.lit(a)), plain=rewards.score(F.lit("res"), F.lit(b), F.lit(a)), psg=rewards.score(F.lit("psg"), F.lit(tri % (a, b)), F.lit(tri % (a, b))),
        refused=F.size(rewards.triplets(F.lit(swapped % (a, b)))), often3=rewards.scene_graph_fresh(F.lit((tri % (a, b)) * 3)), twice=rewards.scene_graph_fresh(F.lit((tri % (a, b)) * 2)), spaced=rewards.scene_graph_reward(F.lit((tri % (a, b)).replace(": ", ":")), F.lit(tri % (a, b))),
        strip=rewards.strip_masks(F.lit(f"x{a}<|mt_foo|>y")), short=rewards.repair_short(F.lit("<|mt_start|><|mt_0186|><|mt_0410|><|mt_0186|><|mt_end|>")),
    )
    assert (r.same, r.half, r.none, r.null, r.often, r.fmt, r.graph) == (1.0, 0.4, 1.0, 0.0, 0.0, 1.0, 1.0)
    assert r.graph2 == pytest.approx(0.5 + 0.4 * 0.25 + 0.25)
    assert r.gcg == 1.0 and r.score["overall"] == pytest.approx(4.0) and r.plain["overall"] == pytest.approx(2.4) and r.psg["overall"] == pytest.approx(3.0)
    assert (r.refused, r.often3, r.twice, r.spaced) == (0, 0.0, 1.0, 1.0) and r.strip == "x<|mt_foo|>y" and r.short.count("mt_") == 5
    with pytest.raises(Exception, match="no reward"):
        one(spark, x=rewards.score(F.lit("other"), F.lit("a"), F.lit("b")))


def test_text(spark):
    r = one(
        spark, plain=text.normalise_messages(F.lit("hello")), single=text.normalise_messages(F.lit('{"from": "gpt", "value": "x"}')), null=F.size(text.normalise_messages(F.lit(None).cast("string"))),
        parts=text.interleave(F.lit("a <image>\nb"), F.array(F.lit("p.jpg"))), tie=text.winner(F.lit("both images are equally good")), one_=text.winner(F.lit("I think image 2 is clearly better")),
        js=text.fenced_json(F.lit("```json\n[1]\n```")).isNull(), key=text.natural_key(F.lit("f10")) > text.natural_key(F.lit("f9")),
    )
    assert [(m["from"], m["value"]) for m in r.plain] == [("human", "hello")] and r.single[0]["from"] == "gpt" and r.null == 0
    assert [(p["type"], p["value"]) for p in r.parts] == [("text", "a "), ("image", "p.jpg"), ("text", "b")]
    q = one(
        spark, tail=text.normalise_messages(F.lit('"Red cup" is on the left')), listed=text.normalise_messages(F.lit('["a", {"from": "gpt", "value": "b"}, "{\\"from\\": \\"gpt\\", \\"value\\": \\"c\\"}", 7]')),
        two=text.json_answer(F.lit('{"a":1} and {"b":2}')).isNull(), array=F.try_variant_get(text.json_answer(F.lit("x</think> [1, 2]")), "$[1]", "int"), dims=text.dimensions(F.lit("A / B; C / D / E / F; G")),
        none=F.size(text.pair_scores(F.lit("scores: 4, 5"))), some=text.pair_scores(F.lit("score 4,5")), named=text.pair_scores(F.lit("Image 1: 3.5 and image 2 gets 4")),
        point=text.pointwise_scores(F.lit("{'score': ['7 of 10', 5], 'reasoning': 'ok'}")), bare=text.pointwise_scores(F.lit('so "score": [3] it is')), asked=text.asked_dimensions(F.lit("Quality, Alignment")), every=F.size(text.asked_dimensions(F.lit(None).cast("string"))),
        pick=text.primary_score(text.judge_output(F.lit("Image 2 is better"), F.lit("edit_pairwise_rank")), F.lit("edit_pairwise_rank")),
    )
    said = lambda ms: [(m["from"], m["value"]) for m in ms]
    assert said(q.tail) == [("human", '"Red cup" is on the left')] and said(q.listed) == [("human", "a"), ("gpt", "b"), ("gpt", "c"), ("human", "7")]
    assert q.two and q.array == 2 and [tuple(d) for d in q.dims] == [("A", "B", "B"), ("C", "D", "E")]
    assert q.none == 0 and q.some == [4.0, 5.0] and q.named == [3.5, 4.0]
    assert tuple(q.point) == (7.0, 5.0, 6.0, "ok") and tuple(q.bare) == (3.0, None, 3.0, None) and q.asked == ["Quality", "Alignment"] and q.every == 5 and q.pick == [2.0]
    assert r.tie.endswith("equally good") and r.one_ == "Edited image 2" and r.js and r.key


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=30))
def test_run_lengths_round_trip(spark, bits):
    c = ints(*bits)
    r = one(spark, back=arrays.from_run_lengths(arrays.run_lengths(c)))
    assert list(r.back) == bits


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_is_a_partition(sizes, k):
    sets = balance.differencing(sizes, k)
    assert len(sets) == k and sorted(i for s in sets for i in s) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) <= max(sizes)


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (3, 5), (5, 2), (1, 1)):
        w = rng.random((n, m))
        k = min(n, m)
        best = max(sum(w[r, c] for r, c in zip(rs, cs, strict=True)) for rs in itertools.combinations(range(n), k) for cs in itertools.permutations(range(m), k))
        assert sum(w[a] for a in balance.assign(w)) == pytest.approx(best)
    assert balance.assign(np.zeros((0, 3))) == []


def test_gae_and_returns(spark):
    r = one(
        spark, ret=advantage.discounted_returns(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]), ints(1, 1, 0, 1), 0.5),
        adv=advantage.generalised_advantages(F.array(*[F.lit(float(x)) for x in (0, 0, 1)]), F.array(*[F.lit(float(x)) for x in (0.1, 0.2, 0.3)]), ints(1, 1, 1), 1.0, 1.0),
        reward=advantage.token_reward(F.lit(2.0), F.lit(2), F.lit(4)), no=advantage.token_reward(F.lit(2.0), F.lit(0), F.lit(2)),
    )
    assert list(r.ret) == pytest.approx([2.0, 2.0, 5.0, 4.0])
    assert list(r.adv) == pytest.approx([0.9, 0.8, 0.7])
    assert list(r.reward) == [0.0, 2.0, 0.0, 0.0] and list(r.no) == [0.0, 0.0]


def test_group_advantages_sum_to_zero(spark):
    df = spark.createDataFrame([(g, float(i * i % 7)) for g in range(3) for i in range(5)] + [(9, 1.0)], "g int, v double")
    out = df.select("g", advantage.group_normalised(F.col("v"), "g").alias("a")).groupBy("g").agg(F.sum("a").alias("s")).collect()
    assert all(r.s is None if r.g == 9 else abs(r.s) < 1e-6 for r in out)


def test_group_advantages_equal_the_windows(spark):
    df = spark.createDataFrame([(None if g == 2 else g, float(i * i % 7)) for g in range(4) for i in range(5)] + [(9, 1.0)], "g int, v double")
    for kind, window in (("grpo", advantage.group_normalised), ("rloo", advantage.leave_one_out)):
        a = sorted((r.g is None, r.g or 0, r.v, round(r.a or 0, 9)) for r in df.select("g", "v", window(F.col("v"), "g").alias("a")).collect())
        b = sorted((r.g is None, r.g or 0, r.v, round(r.advantage or 0, 9)) for r in advantage.group_advantages(df, "v", "g", kind=kind).collect())
        assert a == b
    assert advantage.group_softmax(df, "v", "g").agg(F.sum("p")).first()[0] == pytest.approx(5)


def test_controllers_and_distance():
    c = advantage.kl_controller("adaptive", 0.1, 0.1, 100)
    assert c.update(1.0, 10) == pytest.approx(0.102) and advantage.kl_controller("fixed", 0.3).update(9, 9) == 0.3
    m, cov = np.zeros(3), np.eye(3)
    assert aggregates.frechet_distance(m, cov, m, cov) == pytest.approx(0, abs=1e-4)
    assert aggregates.frechet_distance(m, cov, m + 2, cov) == pytest.approx(12, abs=1e-3)


def test_polygon_fill_and_codes(spark):
    rng = np.random.default_rng(2)
    for _ in range(20):
        ring = rng.random(2 * int(rng.integers(3, 8))) * 20
        got, xy = masks.fill_polygon(ring, 18, 22), ring.reshape(-1, 2)
        for r in range(18):
            for c in range(22):
                inside = False
                for (xa, ya), (xb, yb) in zip(xy, np.roll(xy, -1, axis=0), strict=True):
                    if (ya <= r + 0.5) != (yb <= r + 0.5) and c + 0.5 >= xa + (r + 0.5 - ya) / (yb - ya) * (xb - xa):
                        inside = not inside
                assert got[r, c] == inside
        runs = masks.runs_of_bitmap(got)
        assert sum(runs) == got.size and sum(runs[1::2]) == got.sum()
        assert masks.decode_counts(masks.encode_counts(runs)) == runs
    assert masks.decode_counts("\x01") is None and masks.encode_counts([]) == ""
    square = masks.runs_of_bitmap(masks.fill_polygon(np.array([1, 1, 4, 1, 4, 3, 1, 3]), 5, 6))
    df = spark.createDataFrame([(1, square), (1, square), (2, [2, 3, 25])], "k int, runs array<int>")
    assert {r.k: r.area for r in masks.union_area(df, "k", "runs").collect()} == {1: 6, 2: 3}
    r = df.where("k = 2").select(masks.area(F.col("runs")).alias("a"), masks.iou(F.col("runs"), F.col("runs")).alias("i")).first()
    assert (r.a, r.i) == (3, 1.0)


def test_nested_masks_are_dropped(spark):
    rows = [([0, 10, 10],), ([2, 3, 15],), ([8, 5, 7],), ([0, 10, 10],), ([20],)]
    df = spark.createDataFrame([([r for r in rows],)], "m array<struct<runs:array<int>>>")
    assert df.select(masks.drop_nested(F.col("m")).alias("k")).first().k == [[0, 10, 10], [8, 5, 7], [20]]


def test_scores_and_moving_averages(spark):
    s = spark.createDataFrame([("x", "Colour", 1.0), ("Wrong", "Lighting", 2.0), (None, "Other", 3.0)], "l2 string, l3 string, s double")
    out = {(r.l2, r.l3) for r in aggregates.rehome_scores(s, {"Color": "Art", "Lighting": "Photo"}, {"Colour": "Color"}).collect()}
    assert out == {("Art", "Color"), ("Photo", "Lighting"), ("Other", "Other")}
    old = spark.createDataFrame([(0, 10.0, [1.0]), (1, 4.0, [2.0])], "code int, n double, mean array<double>")
    new = spark.createDataFrame([(0, 20.0, [3.0])], "code int, n double, mean array<double>")
    got = {r.code: (r.n, r["mean"]) for r in aggregates.codebook_ema(old, new, 0.5).collect()}
    assert got == {0: (15.0, [2.0]), 1: (2.0, [2.0])}
    t = aggregates.timing_metrics(spark.createDataFrame([("gen", 2.0), ("update", 4.0)], "section string, seconds double"), spark.createDataFrame([(100, 400)], "response_tokens int, all_tokens int"))
    assert {r.section: r.ms_per_token for r in t.collect()} == {"gen": 20.0, "update": 10.0}


def test_labels(spark):
    head = [128006, 78191, 128007, 271]
    ids = [1, *head, 5, 6, 128009, 7, *head, 8, 128009, *head, 9]
    role = [1, 77091, 198, 5, 6, 151645, 198, 3, 77091, 198, 8]
    r = one(spark, a=arrays.header_labels(ints(*ids)), b=arrays.role_labels(ints(*role)), none=arrays.header_labels(ints(1, 2)), empty=arrays.header_labels(ints()))
    x = -100
    assert r.a == [x, x, x, x, x, 5, 6, 128009, x, x, x, x, x, 8, 128009, x, x, x, x, x] and r.b == [x, x, x, 5, 6, 151645, 198, x, x, x, x] and r.none == [x, x] and r.empty == []


def test_full_divergence_and_objectives(spark):
    a, b = np.log([0.2, 0.3, 0.5]), np.log([0.5, 0.25, 0.25])
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, k=advantage.full_kl(arr(a), arr(b))).k == pytest.approx(float((np.exp(a) * (a - b)).sum()))
    rng = np.random.default_rng(1)
    old, new, adv = (rng.normal(0, 0.4, (6, 5)) for _ in range(3))
    mask = (rng.random((6, 5)) < 0.7).astype(int)
    df = spark.createDataFrame([(o.tolist(), n.tolist(), a.tolist(), m.tolist()) for o, n, a, m in zip(old, new, adv, mask, strict=True)], "o array<double>, n array<double>, a array<double>, m array<int>")
    gap = new - old
    seq = (gap * mask).sum(1) / (mask.sum(1) + 1e-8)
    for kind in ("default", "gspo", "gspo_token", "cispo"):
        lr = {"gspo": seq[:, None] * mask, "gspo_token": np.repeat(seq[:, None], 5, 1)}.get(kind, gap)
        ratio, clip = np.exp(np.clip(lr, -20, 20)), np.exp(np.clip(lr, np.log(0.8), np.log(1.28)))
        up = np.maximum(-adv * ratio, -adv * clip)
        loss = -adv * new * clip if kind == "cispo" else np.where(adv < 0, np.minimum(up, -adv * 3), up)
        for mode in ("token", "seq"):
            want = (loss * mask).sum() / mask.sum() if mode == "token" else ((loss * mask).sum(1) / (mask.sum(1) + 1e-8)).mean()
            r = advantage.policy_objective(df, "o", "n", "a", "m", kind, mode).first()
            assert r.loss == pytest.approx(want, abs=1e-6) and r.kl == pytest.approx(-(gap * mask).sum() / mask.sum(), abs=1e-6)
            if kind != "cispo":
                assert r.clipped_higher == pytest.approx(((-adv * ratio < -adv * clip) * mask).sum() / mask.sum(), abs=1e-6)


def test_masks_match(spark):
    a, b, c = [2, 4, 4], [4, 4, 2], [10]
    r = one(spark, iou=masks.iou(ints(*a), ints(*b)), none=masks.iou(ints(*c), ints(*c)), m=masks.matched_iou(F.array(ints(*a), ints(*b)), F.array(ints(*b))), shared=F.size(masks.intervals(ints(*a))))
    assert r.iou == pytest.approx(2 / 6) and r.none == 0.0 and r.m == pytest.approx(0.5) and r.shared == 1


def test_partitions():
    assert [len(s) for s in balance.differencing([5, 4, 3, 2, 1, 9], 3, equal_size=True)] == [2, 2, 2]
    assert balance.greedy([3, 3, 2, 2], 2) == [[0, 2], [1, 3]] and sorted(map(len, balance.greedy([9, 1, 1, 1], 2, equal_size=True))) == [2, 2]
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, equal_size=True)
