"""Mixtures of sources at target weights by Poisson replication.

Every document has a uniform number ``u`` from a seeded hash of its key.  With
rate ``r`` it is used ``k`` times, ``k`` being the ``u``-quantile of a Poisson
distribution of mean ``r``, at most ``max_repeat``.  For fixed ``u`` the count
grows with the rate, so the rate at which a document gets its k-th copy can be
told beforehand (``P(X >= k; r) = 1 - u`` solved for ``r``).  A document is
exploded into these thresholds, and a source's rate is the one at which the
tokens of all copies below it reach the source's share: found from two
histograms of thresholds (coarse, then the bin where the target falls), each one
aggregate of bounded size.  Shares are met on the actual sizes, not only in the
mean, without ranking a source and without any group in one task.

The size of the mixture is a parameter; by default it is the largest the caps
allow, ``min(max_repeat * tokens / share)``.

Defined results: sources without tokens are left out and the other shares
scaled up; documents without tokens, without a listed source or key are left
out; a cap of null or below one allows no use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from millrace.llm import lexicon
from millrace.runtime import materialize

BINS = 2048
SEED = 20240607


def copy_rates(u: np.ndarray, k: int) -> np.ndarray:
    """The Poisson mean at which the ``u``-quantile reaches ``k``: ``P(X < k; rate) = u``, by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 60.0 + 4.0 * k)
    for _ in range(60):
        mid = (low + high) / 2
        term = np.exp(-mid)
        below = term.copy()
        for j in range(1, k):
            term = term * mid / j
            below += term
        more = below > u  # too many documents still below k: the rate must grow
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return (low + high) / 2


@F.pandas_udf(ArrayType(DoubleType()))
def _rates(u: pd.Series, cap: pd.Series) -> pd.Series:
    most = int(cap.max()) if len(cap) else 0
    x = u.to_numpy(dtype=float)
    table = np.stack([copy_rates(x, k) for k in range(1, most + 1)], axis=1) if most > 0 else np.zeros((len(x), 0))
    return pd.Series([table[i, : int(c)].tolist() for i, c in enumerate(cap)])


def copies(documents: DataFrame, targets: DataFrame, tokenizer: str = lexicon.TOKENIZER, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, copy, rate`` of every copy the caps allow."""
    caps = {r["source"]: int(r["max_repeat"]) for r in targets.collect() if r["source"] is not None and (r["max_repeat"] or 0) >= 1}  # the sources asked for
    if not caps:
        return documents.where(F.lit(False)).select("doc_id", "source", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).alias("copy"), F.lit(0.0).alias("rate"))
    listed = documents.where(F.col("doc_id").isNotNull() & F.col("source").isin(*caps))
    # filtered after it is written: a filter on a Python column would be part of its stage only
    sized = materialize(lexicon.sizes(listed, tokenizer, keep=("source",)), "p8-tokens").where(F.col("n_tokens") > 0)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    cap = F.element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    rated = sized.select("doc_id", "source", "n_tokens", F.posexplode(_rates(u, cap)).alias("copy", "rate"))
    return materialize(rated, "p8-copies")


def _rate_of_each(rated: DataFrame, targets: DataFrame, total: int | None) -> dict[str, tuple[float, float]]:
    """source -> (rate bound, share asked of the mixture)."""
    asked = {r["source"]: r["target_share"] for r in targets.collect()}
    size = {r["source"]: r for r in rated.groupBy("source").agg(F.sum("n_tokens").alias("most"), F.min("rate").alias("lo"), F.max("rate").alias("hi")).collect()}
    share = {s: w for s, w in asked.items() if s in size and w and w > 0}
    whole = sum(share.values())
    if not share:
        return {}
    most = min(size[s]["most"] * whole / w for s, w in share.items())
    want = {s: min(most, total or most) * w / whole for s, w in share.items()}
    lo, hi, base = {}, {}, dict.fromkeys(share, 0)
    for s in share:
        lo[s], hi[s] = size[s]["lo"] * (1 - 1e-12), size[s]["hi"] * (1 + 1e-9)
    for _ in range(3):  # histograms of at most BINS rows a source
        at = lambda m: F.element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("source"))
        part = rated.where(F.col("source").isin(*share)).withColumn("b", F.floor((F.col("rate") - at(lo)) / (at(hi) - at(lo)) * BINS))
        rows = part.where((F.col("b") >= 0) & (F.col("b") < BINS)).groupBy("source", "b").agg(F.sum("n_tokens").alias("n")).collect()
        for s in share:
            bins = np.zeros(BINS)
            for r in rows:
                if r["source"] == s:
                    bins[r["b"]] = r["n"]
            step = (hi[s] - lo[s]) / BINS
            cum = np.cumsum(bins)
            k = int(np.searchsorted(cum, want[s] - base[s] - 1e-9))
            if k >= BINS:
                lo[s] = hi[s]
                hi[s] = hi[s] + step
                base[s] += float(cum[-1])
                continue
            base[s] += float(cum[k - 1]) if k else 0.0
            lo[s], hi[s] = lo[s] + k * step, lo[s] + (k + 1) * step
    return {s: (hi[s], share[s] / whole) for s in share}


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = lexicon.TOKENIZER, seed: int = SEED) -> DataFrame:
    """``doc_id, copy, source, n_tokens, shuffle_key``: the mixture in globally shuffled order."""
    rated = copies(documents, targets, tokenizer, seed)
    bounds = _rate_of_each(rated, targets, total)
    if not bounds:
        return rated.where(F.lit(False)).select("doc_id", "copy", "source", "n_tokens", F.lit(0).cast("bigint").alias("shuffle_key"))
    bound = F.element_at(F.create_map(*[x for s, (r, _) in bounds.items() for x in (F.lit(s), F.lit(float(r)))]), F.col("source"))
    chosen = rated.where(F.col("source").isin(*bounds)).where(F.col("rate") <= bound)
    return chosen.select("doc_id", "copy", "source", "n_tokens", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("shuffle_key")).orderBy("shuffle_key", "doc_id", "copy")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_documents, most_used, max_repeat``: what was reached."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    per = materialize(per_doc.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n").alias("most_used")), "p8-shares")
    total = per.agg(F.sum("n_tokens")).first()[0] or 1
    return targets.join(F.broadcast(per), "source", "left").select(
        "source", "target_share", F.round(F.coalesce("n_tokens", F.lit(0)) / F.lit(total), 6).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeat",
    )
