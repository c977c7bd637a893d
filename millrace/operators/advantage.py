"""Group-wise score normalisation, returns, estimators and objectives.

Row-level estimators that need totals of a group only are aggregates joined back
(``group_advantages``); running values along groups of any size are distributed
scans (``operators.scans``).  On batches with one array per sequence, recurrences
run in Arrow batches (``functions.scans``) and the rest stays in the JVM.

The estimators of ``ESTIMATORS`` share one form: a batch with the array columns
``rewards`` and ``mask`` (and ``values``, ``uid``, ``baseline`` where they are
needed) goes in, the batch with ``advantages`` and ``returns`` comes out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scans import backward
from millrace.operators.scans import running, running_count
from millrace.registry import Registry
from millrace.runtime import broadcast_if_small, materialize

EPS = 1e-6
ESTIMATORS = Registry("advantage estimator")


def with_group_stats(df: DataFrame, score: str, *group: str) -> DataFrame:
    """``df`` with ``_n, _sum, _avg, _std, _max`` of its group.

    Aggregated with map-side combine and joined back, so a group that holds a
    large share of the rows is never sorted in one task (the join's stream side
    is split by AQE; a small set of groups is broadcast after a check of its size).
    """
    c = F.col(score)
    stats = df.groupBy(*group).agg(F.count(c).alias("_n"), F.sum(c).alias("_sum"), F.avg(c).alias("_avg"), F.stddev_samp(c).alias("_std"), F.max(c).alias("_max"))
    stats = stats.withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])  # a null group is a group
    return df.join(broadcast_if_small(stats), same).drop(*[f"_g_{g}" for g in group])


def group_advantages(df: DataFrame, score: str, *group: str, kind: str = "grpo", eps: float = EPS) -> DataFrame:
    """``df`` with ``advantage``: normalised by the group (grpo) or against the mean of the others (rloo); null in groups of one."""
    out = with_group_stats(df, score, *group)
    c = F.col(score)
    value = {"grpo": (c - F.col("_avg")) / (F.col("_std") + F.lit(eps)), "rloo": c - (F.col("_sum") - c) / (F.col("_n") - 1)}[kind]
    return out.withColumn("advantage", F.when(F.col("_n") > 1, value)).drop("_n", "_sum", "_avg", "_std", "_max")


def group_softmax(df: DataFrame, score: str, *group: str) -> DataFrame:
    """``df`` with ``p``: softmax of the score over its group, in two aggregates."""
    shifted = with_group_stats(df, score, *group).withColumn("_e", F.exp(F.col(score) - F.col("_max"))).drop("_n", "_sum", "_avg", "_std", "_max")
    return with_group_stats(shifted, "_e", *group).withColumn("p", F.col("_e") / F.col("_sum")).drop("_e", "_n", "_sum", "_avg", "_std", "_max")


def group_normalised(score: Column, *group: str, eps: float = EPS) -> Column:
    """(score - group mean) / (sample deviation + eps); null in groups of one."""
    w = Window.partitionBy(*group)
    return F.when(F.count(score).over(w) > 1, (score - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + F.lit(eps)))


def leave_one_out(score: Column, *group: str) -> Column:
    """Score minus the mean of the other scores of its group; null in groups of one."""
    w = Window.partitionBy(*group)
    n = F.count(score).over(w)
    return F.when(n > 1, score - (F.sum(score).over(w) - score) / (n - 1))


def best_of_group(df: DataFrame, score: str, tie: str, *group: str, eps: float = EPS, zero_rest: bool = False) -> DataFrame:
    """``df`` with ``advantage``: the best row (ties: the least ``tie``) gets its lead over the second best in deviations; the others keep their score (or get 0).

    The two best of a group come from a top-two aggregate, the deviation from a second one; no group is sorted.  Null in groups of one.
    """
    row = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    best = df.where(F.col(score).isNotNull()).groupBy(*group).agg(F.min(row).alias("_best"), F.stddev_samp(score).alias("_sd"), F.count(score).alias("_n"))
    same = lambda d, m: reduce(lambda a, b: a & b, [d[g].eqNullSafe(m[f"_g_{g}"]) for g in group])
    named = best.withColumnsRenamed({g: f"_g_{g}" for g in group})
    out = df.join(broadcast_if_small(named), same(df, named), "left").drop(*[f"_g_{g}" for g in group])
    first = F.coalesce((F.col(score) == -F.col("_best.s")) & F.col(tie).eqNullSafe(F.col("_best.t")), F.lit(False))
    second = out.where(~first).groupBy(*group).agg(F.max(score).alias("_second")).withColumnsRenamed({g: f"_g_{g}" for g in group})
    out = out.join(broadcast_if_small(second), same(out, second), "left").drop(*[f"_g_{g}" for g in group])
    lead = (F.col(score) - F.col("_second")) / (F.col("_sd") + F.lit(eps))
    value = F.when(F.col("_n") > 1, F.when(first, lead).otherwise(F.lit(0.0) if zero_rest else F.col(score)))
    return out.withColumn("advantage", value).drop("_best", "_sd", "_n", "_second")


def return_to_go(df: DataFrame, reward: Column, group: str, *order: Column, out: str = "ret") -> DataFrame:
    """``df`` with the sum of this and all later rewards of a group, of any size."""
    return running(df, [group], [o.desc() for o in order], reward, out=out).drop(f"{out}_before")


def discounted_rows(df: DataFrame, reward: Column, group: str, *order: Column, gamma: float, out: str = "ret") -> DataFrame:
    """``df`` with the discounted return of every row over all later rows of its group, of any size."""
    return running(df, [group], [o.desc() for o in order], reward, F.lit(gamma), out=out).drop(f"{out}_before")


def gae_rows(df: DataFrame, reward: Column, value: Column, mask: Column, group: str, *order: Column, gamma: float, lam: float) -> DataFrame:
    """``df`` with ``advantage`` (not whitened) and ``returns`` of every row; masked rows pass the later value on."""
    back, m = [o.desc() for o in order], (mask > 0).cast("double")
    later = running(df, [group], back, m * value, 1 - m, out="_next")
    delta = reward + F.lit(gamma) * F.col("_next_before") - value
    out = running(later, [group], back, m * delta, m * F.lit(gamma * lam) + 1 - m, out="advantage")
    return out.withColumn("returns", F.col("advantage") + value).drop("_next", "_next_before", "advantage_before")


def whiten_rows(df: DataFrame, value: Column, mask: Column, out: str = "white", eps: float = 1e-8) -> DataFrame:
    """``df`` with ``value`` whitened by mean and sample deviation of the masked rows of the whole table (two one-row aggregates)."""
    mean = df.agg((F.sum(value * mask) / (F.sum(mask) + F.lit(eps))).alias("_mean"))
    near = df.join(F.broadcast(mean), F.lit(True))
    gap = value - F.col("_mean")
    plain, n = F.sum(gap * gap * mask) / (F.sum(mask) + F.lit(eps)), F.sum(mask)
    var = near.agg(F.when(n > 1, plain * n / (n - 1)).otherwise(plain).alias("_var"))  # one row of the mask or none: without the correction
    return near.join(F.broadcast(var), F.lit(True)).withColumn(out, gap / F.sqrt(F.col("_var") + F.lit(eps))).drop("_mean", "_var")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def _masked(values: Column, mask: Column) -> Column:
    return F.zip_with(values.cast("array<double>"), mask, lambda x, m: x * m)


def whiten_batch(df: DataFrame, column: str, mask: str = "mask", eps: float = 1e-8) -> DataFrame:
    """``df`` with an array column whitened over all masked elements of the batch."""
    m = _total(F.col(mask).cast("array<double>"))
    mean = df.agg((F.sum(_total(_masked(F.col(column), F.col(mask)))) / (F.sum(m) + F.lit(eps))).alias("_mean"))
    near = df.join(F.broadcast(mean), F.lit(True))
    square = F.zip_with(F.col(column), F.col(mask), lambda x, k: (x - F.col("_mean")) * (x - F.col("_mean")) * k)
    plain, n = F.sum(_total(square)) / (F.sum(m) + F.lit(eps)), F.sum(m)
    var = near.agg(F.when(n > 1, plain * n / (n - 1)).otherwise(plain).alias("_var"))
    scaled = F.transform(column, lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + F.lit(eps)))
    return near.join(F.broadcast(var), F.lit(True)).withColumn(column, scaled).drop("_mean", "_var")


def _shifted(values: Column) -> Column:
    """The element one place later, 0 at the end."""
    return F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Per row: discounted return of every position, the running return starting anew after mask 0."""
    return backward(rewards, F.transform(_shifted(mask.cast("array<double>")), lambda m: m * F.lit(gamma)))


def generalised_advantages(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Per row: advantages of every position by the reverse recursion; masked positions pass the later value on."""
    m = F.transform(mask, lambda x: (x > 0).cast("double"))
    held = backward(_masked(values, m), F.transform(m, lambda x: 1 - x))
    delta = F.zip_with(F.zip_with(rewards, _shifted(held), lambda r, n: r + F.lit(gamma) * n), values, lambda x, v: x - v)
    return backward(_masked(delta, m), F.transform(m, lambda x: x * F.lit(gamma * lam) + 1 - x))


def _outcome(df: DataFrame, score: Column) -> DataFrame:
    """One score a sequence at every position of its mask, as advantages and returns."""
    spread = F.transform("mask", lambda m: m.cast("double") * score)
    return df.withColumns({"advantages": spread, "returns": spread})


def _several(n: Column, value: Column) -> Column:
    return F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group has one sequence only")).cast("double"))


@ESTIMATORS.register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    adv = df.withColumn("advantages", generalised_advantages(F.col("rewards"), F.col("values"), F.col("mask"), gamma, lam))
    adv = materialize(adv.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v)), "gae")  # whitening reads it three times
    return whiten_batch(adv, "advantages")


@ESTIMATORS.register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    ret = materialize(df.withColumn("returns", discounted_returns(F.col("rewards"), F.col("mask"), gamma)), "reinforce")
    return whiten_batch(ret.withColumn("advantages", F.col("returns")), "advantages")


@ESTIMATORS.register("grpo")
def grpo(df: DataFrame, eps: float = EPS) -> DataFrame:
    out = with_group_stats(df.withColumn("_score", _total(F.col("rewards"))), "_score", "uid")
    score = _several(F.col("_n"), (F.col("_score") - F.col("_avg")) / (F.col("_std") + F.lit(eps)))
    return _outcome(out, score).drop("_score", "_n", "_sum", "_avg", "_std", "_max")


@ESTIMATORS.register("grpo_passk")
def grpo_passk(df: DataFrame, tie: str = "row", eps: float = EPS) -> DataFrame:
    out = best_of_group(df.withColumn("_score", _total(F.col("rewards"))), "_score", tie, "uid", eps=eps)
    return _outcome(out, F.coalesce("advantage", F.raise_error(F.lit("a group has one sequence only")).cast("double"))).drop("_score", "advantage")


@ESTIMATORS.register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    out = with_group_stats(df.withColumn("_score", _total(F.col("rewards"))), "_score", "uid")
    score = _several(F.col("_n"), F.col("_score") - (F.col("_sum") - F.col("_score")) / (F.col("_n") - 1))
    return _outcome(out, score).drop("_score", "_n", "_sum", "_avg", "_std", "_max")


@ESTIMATORS.register("remax")
def remax(df: DataFrame) -> DataFrame:
    """Advantage: all rewards of the sequence less its baseline; return: the reward to go."""
    lead = _total(F.col("rewards")) - F.col("baseline")
    ret = backward(_masked(F.col("rewards"), F.col("mask")), F.transform("mask", lambda _: F.lit(1.0)))
    return df.withColumns({"advantages": F.transform("mask", lambda m: m.cast("double") * lead), "returns": ret})


def token_reward(score: Column, length: Column, width: Column) -> Column:
    """The score at the last valid position, zero elsewhere; no reward for an empty response."""
    return F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.when((length > 0) & (i == length - 1), score).otherwise(F.lit(0.0)))


def kl(logp: Column, ref: Column, kind: str = "kl") -> Column:
    """Per-token divergence estimate of two log-probabilities; of ``full`` the terms of the vocabulary are added up (``full_kl``)."""
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return F.lit(0.5) * d * d
    if kind == "low_var_kl":
        back = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(back) - back - 1, F.lit(-10.0)), F.lit(10.0))
    if kind == "full":
        return F.exp(logp) * d
    raise NotImplementedError(kind)


def full_kl(logp: Column, ref: Column) -> Column:
    """Divergence of two distributions given as arrays of log-probabilities."""
    return _total(F.zip_with(logp, ref, lambda a, b: kl(a, b, "full")))


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clipped_policy_loss(old: Column, new: Column, adv: Column, low: float = 0.2, high: float = 0.28, dual: float = 3.0) -> Column:
    """Dual-clipped surrogate of one token."""
    return _surrogate(new - old, new, adv, "default", low, high, dual)["loss"]


def _surrogate(log_ratio: Column, new: Column, adv: Column, kind: str, low: float, high: float, dual: float) -> dict[str, Column]:
    """Loss of one token and whether it was clipped at the higher or the lower side."""
    ratio, clipped = F.exp(_clamp(log_ratio, -20.0, 20.0)), F.exp(_clamp(log_ratio, math.log(1 - low), math.log(1 + high)))
    if kind == "cispo":
        return {"loss": -adv * new * clipped}
    plain, held, most = -adv * ratio, -adv * clipped, -adv * dual
    upper = F.greatest(plain, held)
    return {
        "loss": F.when(adv < 0, F.least(upper, most)).otherwise(upper),
        "higher": (plain < held).cast("double"), "lower": ((upper > most) & (adv < 0)).cast("double"),
    }


def policy_objective(
    df: DataFrame, old: str, new: str, adv: str, mask: str, kind: str = "default", mode: str = "token", low: float = 0.2, high: float = 0.28, dual: float = 3.0, eps: float = 1e-8,
) -> DataFrame:
    """One row ``loss, entropy, kl[, clipped_higher, clipped_lower]`` of a batch with one array per sequence.

    ``kind``: default (dual clip), gspo and gspo_token (ratio of the whole sequence), cispo.
    ``mode``: mean over tokens or mean of the sequences' means.
    """
    if kind not in ("default", "gspo", "gspo_token", "cispo") or mode not in ("token", "seq"):
        raise NotImplementedError(f"{kind}, {mode}")
    gap = F.zip_with(new, old, lambda n, o: n - o)
    count = _total(F.col(mask).cast("array<double>"))
    whole = _total(_masked(gap, F.col(mask))) / (count + F.lit(eps))
    t = F.arrays_zip(F.col(new).alias("new"), gap.alias("gap"), F.col(adv).alias("adv"), F.col(mask).cast("array<double>").alias("m"))
    rows = df.select(t.alias("t"), count.alias("n"), whole.alias("whole"))

    def parts(x: Column) -> dict[str, Column]:
        log_ratio = {"gspo": F.col("whole") * x["m"], "gspo_token": F.col("whole")}.get(kind, x["gap"])
        return _surrogate(log_ratio, x["new"], x["adv"], kind, low, high, dual)

    names = ("loss",) if kind == "cispo" else ("loss", "higher", "lower")
    total = lambda f: _total(F.transform("t", f))
    part = lambda k: total(lambda x: parts(x)[k] * x["m"])
    sums = rows.select("n", *[part(k).alias(k) for k in names], total(lambda x: -x["new"] * x["m"]).alias("entropy"), total(lambda x: -x["gap"] * x["m"]).alias("kl"))
    by_token = lambda c: F.sum(c) / (F.sum("n") + F.lit(eps))
    mean = by_token if mode == "token" else lambda c: F.avg(F.col(c) / (F.col("n") + F.lit(eps)))
    clipped = [by_token(c).alias(f"clipped_{c}") for c in names[1:]]
    return sums.agg(mean("loss").alias("loss"), mean("entropy").alias("entropy"), by_token("kl").alias("kl"), *clipped)


def clipped_value_loss(pred: Column, target: Column, old: Column, clip: float = 0.5) -> Column:
    held = F.least(F.greatest(pred, old - clip), old + clip)
    return F.lit(0.5) * F.greatest((pred - target) * (pred - target), (held - target) * (held - target))


def value_objective(df: DataFrame, seq: str, pred: Column, target: Column, old: Column, mask: Column, clip: float = 0.5, mode: str = "token", eps: float = 1e-8) -> DataFrame:
    """One row ``loss, clipped, mean_pred`` of token rows; ``mode`` as in ``policy_objective``."""
    held = F.least(F.greatest(pred, old - clip), old + clip)
    hit = ((pred - target) * (pred - target) < (held - target) * (held - target)).cast("double")
    per = df.groupBy(seq).agg(*[F.sum(c * mask).alias(n) for n, c in (("l", clipped_value_loss(pred, target, old, clip)), ("h", hit), ("p", pred), ("n", F.lit(1.0)))])
    by_token = lambda c: F.sum(c) / (F.sum("n") + F.lit(eps))
    loss = by_token("l") if mode == "token" else F.avg(F.col("l") / (F.col("n") + F.lit(eps)))
    return per.agg(loss.alias("loss"), by_token("h").alias("clipped"), by_token("p").alias("mean_pred"))


def position_ids(df: DataFrame, flag: Column, group: str, *order: Column, out: str = "pos") -> DataFrame:
    """``df`` with the running count of valid positions less one, at least 0."""
    done = running_count(df, [group], list(order), flag, out)
    return done.withColumn(out, F.greatest(F.col(out) - 1, F.lit(0))).drop(f"{out}_before")


def up_to_first(df: DataFrame, flag: Column, group: str, *order: Column, out: str = "mask") -> DataFrame:
    """``df`` with 1 up to and including the first flagged row of a group, 0 after."""
    done = running_count(df, [group], list(order), flag, out)
    return done.withColumn(out, (F.col(f"{out}_before") == 0).cast("int")).drop(f"{out}_before")


def kl_penalised(df: DataFrame, scores: str, logp: str, ref: str, mask: str, coef: float, kind: str = "kl") -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``rewards``: scores less the weighted divergence, one row ``current_kl``: mean of the sequences' masked means)."""
    per = F.zip_with(F.zip_with(logp, ref, lambda a, b: kl(a, b, kind)), F.col(mask).cast("array<double>"), lambda d, m: d * m)
    out = df.withColumns({"_kl": per, "rewards": F.zip_with(scores, per, lambda s, d: s - F.lit(coef) * d)})
    mean = out.agg(F.avg(_total(F.col("_kl")) / (_total(F.col(mask).cast("array<double>")) + F.lit(1e-8))).alias("current_kl"))
    return out.drop("_kl"), mean


class AdaptiveKL:
    """Driver-side coefficient that follows a target divergence."""

    def __init__(self, coef: float, target: float, horizon: float) -> None:
        if horizon <= 0:
            raise ValueError("horizon must be positive")
        self.coef, self.target, self.horizon = coef, target, horizon

    def update(self, current: float, steps: int) -> float:
        error = min(max(current / self.target - 1, -0.2), 0.2)
        self.coef *= 1 + error * steps / self.horizon
        return self.coef


class FixedKL(AdaptiveKL):
    def __init__(self, coef: float) -> None:
        self.coef = coef

    def update(self, current: float, steps: int) -> float:
        return self.coef


def kl_controller(kind: str, coef: float, target: float = 0.1, horizon: float = 10_000) -> AdaptiveKL:
    return FixedKL(coef) if kind == "fixed" else AdaptiveKL(coef, target, horizon)
