import datetime as dt
import json
import random

from millrace.operators import nested

ANN = "id bigint, segmentation string, counts string, ingested_at timestamp, kind string, children string, outer string"
T0 = dt.datetime(2024, 1, 1)


def kinds(spark, rows):
    df = spark.createDataFrame([(i, s, c, T0, "x", "y", "z") for i, (s, c) in enumerate(rows)], ANN)
    return {r.id: list(r.kinds) for r in nested.mask_kinds(df).collect()}


def brute(seg, counts):
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)

    def of_counts(c):
        if isinstance(c, list):
            return "run_lengths" if c else None
        if isinstance(c, str) and c.strip():
            try:
                v = json.loads(c)
                return "run_lengths" if isinstance(v, list) and v else "coded_mask"
            except ValueError:
                return "coded_mask"
        return None

    def leaves(x):
        if isinstance(x, str):
            return leaves(json.loads(x))
        if isinstance(x, dict):
            return [x]
        if isinstance(x, list):
            if x and (all(map(num, x)) or all(isinstance(p, list) and len(p) == 2 and all(map(num, p)) for p in x)):
                return [x]
            return [y for e in x for y in leaves(e)]
        return []

    out, items = [], []
    if seg is not None and seg.strip():
        try:
            items = leaves(json.loads(seg))
        except ValueError:
            return ["unreadable"]
    for x in items:
        out.append("polygon" if isinstance(x, list) else of_counts(x.get("counts")) if x.get("counts") is not None else of_counts(counts))
    out = [k for k in out if k]
    return out or ([of_counts(counts)] if of_counts(counts) else [])


def test_shapes(spark):
    mask = {"size": [2, 3], "counts": [1, 2, 3]}
    coded = {"counts": "[]6V^R1x", "size": [2, 3]}
    rows = [
        (None, None), ("", None), ("  \n", "[1, 2]"), ("null", "abc"), ("{}", None), ("[]", None), ("[[]]", None), ("[[1,2,3", None), ("[[1,2", "[1]"),
        ("[1,2,3,4,5,6]", None), ("[[1,2,3,4.5,5,6],[1,2,3,4,5,6]]", None), ("[[1,2],[3,4],[5,6]]", None), ("[[[1,2],[3,4]],[[5,6],[7,8.5]]]", None),
        (json.dumps(mask), None), (json.dumps(coded), None), (json.dumps([[1, 2, 3, 4, 5, 6], mask, coded]), None), (json.dumps({"size": [2, 3]}), "0abc"),
        (json.dumps({"size": [2, 3]}), "[1, 2]"), (json.dumps(json.dumps([mask])), None), (json.dumps(json.dumps({"size": [1, 1]})), "[5]"), (None, ""), ("[1,2] x", None),
        (json.dumps({"size": [1, 1], "counts": ""}), None), (json.dumps({"size": [1, 1], "counts": "[3, 4]"}), None),
    ]
    assert kinds(spark, rows) == {i: brute(*r) for i, r in enumerate(rows)}


def test_random_shapes(spark):
    rng = random.Random(3)

    def leaf():
        return rng.choice([
            lambda: [round(rng.random() * 9, rng.randint(0, 2)) for _ in range(6)], lambda: [[rng.randint(0, 9), rng.random()] for _ in range(3)],
            lambda: {"counts": [rng.randint(0, 9) for _ in range(rng.randint(1, 4))], "size": [1, 2]}, lambda: {"size": [1, 2], "counts": "PQ`" + str(rng.random())},
        ])()

    rows = []
    for _ in range(150):
        x = leaf() if rng.random() < 0.3 else [leaf() for _ in range(rng.randint(0, 4))]
        s = json.dumps(x)
        rows.append((json.dumps(s) if rng.random() < 0.2 else s[: rng.randint(1, len(s))] if rng.random() < 0.1 else s, None))
    assert kinds(spark, rows) == {i: brute(*r) for i, r in enumerate(rows)}


def test_repeats_newest_and_long(spark):
    long = json.dumps([[float(i) for i in range(20_000)]])
    df = spark.createDataFrame([(1, long, None, T0, "", "", ""), (1, long, None, T0, "", "", ""), (1, "[]", None, T0 - dt.timedelta(1), "", "", ""), (None, long, None, T0, "", "", "")], ANN)
    assert [(r.parent_id, r.child_pos, r.n_points) for r in nested.polygons(df).collect()] == [(1, 0, 10_000)]
    assert nested.masks(df.limit(0)).count() == 0


def test_mask_values(spark):
    df = spark.createDataFrame([(1, '{"size": [4, 5]}', "[3, 4]", T0, "", "", ""), (2, '[{"size": [6, 7], "counts": "ab"}]', None, T0, "", "", "")], ANN)
    rows = {r.parent_id: r for r in nested.masks(df).collect()}
    assert (rows[1].runs, rows[1].height, rows[1].width) == ([3, 4], 4, 5)
    assert (rows[2].coded, rows[2].height) == ("ab", 6)


def test_sentences(spark):
    ddl = "ref_id bigint, sentences array<struct<sent_id bigint, sent string, tokens array<string>>>, ingested_at timestamp"
    df = spark.createDataFrame([(1, [(10, None, None), (11, "a b", ["a", "b"])], T0), (1, [(10, None, None), (11, "a b", ["a", "b"])], T0), (2, None, T0), (3, [], T0)], ddl)
    assert sorted((r.child_pos, r.sent, r.n_tokens) for r in nested.sentences(df).collect()) == [(0, None, 0), (1, "a b", 2)]
    assert sorted((r.sent_pos, r.tok_pos, r.token) for r in nested.tokens(df).collect()) == [(1, 0, "a"), (1, 1, "b")]


def test_any_depth(spark):
    ring, mask = [1, 2, 3, 4, 5, 6], {"counts": "ab"}
    inside = lambda n, x: x if n == 0 else inside(n - 1, [x])
    coded = lambda n, x: json.dumps(x) if n == 0 else json.dumps(coded(n - 1, x))
    rows = [(json.dumps(inside(n, ring)), None) for n in (1, 4, 5, 9, 60)] + [(coded(n, [ring, mask]), None) for n in (1, 2, 3, 6)]
    rows += [(json.dumps([ring, [mask, [[[[mask]]], [ring]]]]), None), (json.dumps([coded(3, [[[[ring]]]])]), None)]
    assert kinds(spark, rows) == {i: brute(*r) for i, r in enumerate(rows)}


def test_more_behind_a_value_is_unreadable(spark):
    texts = ["[[1,2,3,4,5,6]] [7,8]", '{"counts":"a"} {"x":1}', "12 abc", "[1,2,3,4,5,6],[1]", "1] [2", '1} {"a":2', '{"counts":"a"}}', '[[1,2,3,4,5,6]],"x"', json.dumps("[1,2,3,4,5,6] x")]
    assert kinds(spark, [(t, "[1, 2]") for t in texts]) == {i: ["unreadable"] for i in range(len(texts))}
