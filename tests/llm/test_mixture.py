import numpy as np
import pytest

from millrace.llm import mixture
from millrace.llm.mixture import copy_rates

TARGETS = "source string, target_share double, max_repeat int"


def test_rates_invert_the_distribution():
    u = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
    for k in (1, 2, 5):
        r = copy_rates(u, k)
        below = sum(np.exp(-r) * r**j / np.prod(np.arange(1, j + 1)) for j in range(k))
        assert below == pytest.approx(u, abs=1e-9)
    assert (copy_rates(u, 2) > copy_rates(u, 1)).all()


def test_shares_and_caps(spark):
    rows = [(n, "word " * (1 + n % 7), "abc"[0 if n % 10 < 7 else 1 if n % 10 < 9 else 2]) for n in range(3000)] + [(9001, None, "a"), (9002, "", "a"), (9003, "x y", None), (9004, "x y", "unlisted")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.25, 4), ("gone", 0.1, 2)], TARGETS)
    mix = mixture.mix(docs, targets)
    rep = {r.source: r for r in mixture.shares(mix, targets).collect()}
    for s, w in (("a", 0.4), ("b", 0.35), ("c", 0.25)):
        assert rep[s].actual_share == pytest.approx(w, abs=0.004) and rep[s].most_used <= rep[s].max_repeat
    assert rep["gone"].n_tokens == 0
    again = mixture.mix(docs, targets)
    assert mix.collect() == again.collect()
    half = mixture.shares(mixture.mix(docs, targets, total=2000), targets).collect()
    assert sum(r.n_tokens for r in half) == pytest.approx(2000, abs=60)


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, text string, source string")
    assert mixture.mix(docs, spark.createDataFrame([], TARGETS)).count() == 0
    assert mixture.mix(docs.limit(0), spark.createDataFrame([("x", 1.0, 2)], TARGETS)).count() == 0
    assert mixture.mix(docs, spark.createDataFrame([("x", 1.0, 0)], TARGETS)).count() == 0
