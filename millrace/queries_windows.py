"""Queries: group-wise windows, returns, token-level objectives, masked and nested aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.operators import advantage, aggregates, balance
from millrace.registry import query
from millrace.runtime import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").drop("ts")


@query("""
SELECT event_id, user_id, round(CASE WHEN count(value) OVER w > 1 THEN (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6) END, 6) AS advantage
FROM events WINDOW w AS (PARTITION BY user_id)""")
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = advantage.group_advantages(_events(spark, sf_dir), "value", "user_id", kind="grpo")
    return out.select("event_id", "user_id", F.round("advantage", 6).alias("advantage"))


@query("""
SELECT event_id, user_id, round(CASE WHEN count(value) OVER w > 1 THEN value - (sum(value) OVER w - value) / (count(value) OVER w - 1) END, 6) AS advantage
FROM events WINDOW w AS (PARTITION BY user_id)""")
def rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = advantage.group_advantages(_events(spark, sf_dir), "value", "user_id", kind="rloo")
    return out.select("event_id", "user_id", F.round("advantage", 6).alias("advantage"))


@query("""
WITH r AS (SELECT event_id, user_id, value, row_number() OVER o AS n, lead(value) OVER o AS second, stddev_samp(value) OVER (PARTITION BY user_id) AS sd, count(*) OVER (PARTITION BY user_id) AS c
           FROM events WINDOW o AS (PARTITION BY user_id ORDER BY value DESC, event_id))
SELECT event_id, user_id, round(CASE WHEN c > 1 THEN CASE WHEN n = 1 THEN (value - second) / (sd + 1e-6) ELSE value END END, 6) AS advantage FROM r""")
def passk_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = advantage.best_of_group(_events(spark, sf_dir), "value", "event_id", "user_id")
    return out.select("event_id", "user_id", F.round("advantage", 6).alias("advantage"))


@query("""
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-7, 4) AS ret FROM events""")
def return_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = advantage.return_to_go(_events(spark, sf_dir), F.col("value"), "user_id", F.col("event_id"))
    return out.select("event_id", "user_id", F.round(F.col("ret") + 1e-7, 4).alias("ret"))  # the same side of exact halves as the SQL


_TOKENS = """
t AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l, r, v, m) - 1)::INT AS pos FROM (
  SELECT l_orderkey, l_linenumber AS l, l_discount - l_tax AS r, l_quantity / 50.0 AS v, (l_returnflag <> 'R')::INT AS m FROM lineitem WHERE l_orderkey IS NOT NULL))"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of sequences: one per order, a token per line."""
    t = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(
        "l_orderkey", F.struct("l_linenumber", (F.col("l_discount") - F.col("l_tax")).alias("r"), (F.col("l_quantity") / 50.0).alias("v"), (F.col("l_returnflag") != "R").cast("int").alias("m")).alias("s"), (F.col("l_orderkey") % 5 / 10.0).alias("baseline"),
    )
    seq = t.groupBy("l_orderkey", "baseline").agg(F.array_sort(F.collect_list("s")).alias("s"))
    pick = lambda n: F.transform("s", lambda x: x[n])
    return seq.select("l_orderkey", F.floor(F.col("l_orderkey") / 7).cast("bigint").alias("uid"), F.col("l_orderkey").alias("row"), "baseline", F.transform("s", lambda _, i: i).alias("line"), pick("r").alias("rewards"), pick("v").alias("values"), pick("m").alias("mask"))


def _tokens(df: DataFrame) -> DataFrame:
    flat = df.select("l_orderkey", F.explode(F.arrays_zip("line", "advantages", "returns")).alias("t"))
    return flat.select("l_orderkey", F.col("t.line").alias("pos"), F.round(F.col("t.advantages") + 1e-9, 5).alias("adv"), F.round(F.col("t.returns") + 1e-9, 5).alias("ret"))


_WHITE = """
w AS (SELECT sum({x} * m) / (sum(m) + 1e-8) AS mu, sum(m) AS kk FROM {t}), z AS (SELECT sum(m * ({x} - mu) * ({x} - mu)) / (any_value(kk) + 1e-8) * any_value(kk) / (any_value(kk) - 1) AS var FROM {t}, w)"""


@query(f"""
WITH {_TOKENS}
SELECT l_orderkey, pos, round((sum(r) OVER (PARTITION BY l_orderkey) - l_orderkey % 5 / 10.0) * m + 1e-9, 5) AS adv,
  round(sum(r * m) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1e-9, 5) AS ret FROM t""")
def remax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(advantage.ESTIMATORS["remax"](_batch(spark, sf_dir)))


@query(f"""
WITH {_TOKENS}, q AS (SELECT *, coalesce(sum(1 - m) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM t),
g AS (SELECT a.l_orderkey, a.pos, any_value(a.m) AS m, sum(b.r * power(0.9, b.pos - a.pos)) AS x
      FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND b.pos >= a.pos AND (b.pos = a.pos OR NOT EXISTS (
        SELECT 1 FROM t c WHERE c.l_orderkey = a.l_orderkey AND c.m = 0 AND c.pos > a.pos AND c.pos <= b.pos)) GROUP BY ALL),
{_WHITE.format(x='x', t='g')}
SELECT l_orderkey, pos, round((x - mu) / sqrt(var + 1e-8) + 1e-9, 5) AS adv, round(x + 1e-9, 5) AS ret FROM g, w, z""")
def reinforce_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(advantage.ESTIMATORS["reinforce_plus_plus"](_batch(spark, sf_dir), gamma=0.9))


@query(f"""
WITH RECURSIVE {_TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos DESC) AS k FROM t),
g AS (SELECT l_orderkey, pos, m, v, k, CASE WHEN m = 1 THEN v ELSE 0.0 END::DOUBLE AS nv, CASE WHEN m = 1 THEN r - v ELSE 0.0 END::DOUBLE AS x FROM n WHERE k = 1
  UNION ALL SELECT n.l_orderkey, n.pos, n.m, n.v, n.k, CASE WHEN n.m = 1 THEN n.v ELSE g.nv END, CASE WHEN n.m = 1 THEN n.r + 0.9 * g.nv - n.v + 0.9 * 0.95 * g.x ELSE g.x END FROM g JOIN n ON n.l_orderkey = g.l_orderkey AND n.k = g.k + 1),
{_WHITE.format(x='x', t='g')}
SELECT l_orderkey, pos, round((x - mu) / sqrt(var + 1e-8) + 1e-9, 5) AS adv, round(x + v + 1e-9, 5) AS ret FROM g, w, z""")
def gae_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(advantage.ESTIMATORS["gae"](_batch(spark, sf_dir), gamma=0.9, lam=0.95))


@query(f"""
WITH {_TOKENS}, s AS (SELECT l_orderkey, sum(r) AS x FROM t GROUP BY l_orderkey),
u AS (SELECT *, floor(l_orderkey / 7)::BIGINT AS g FROM s), c AS (SELECT g, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd, sum(x) AS tot FROM u GROUP BY g),
a AS (SELECT u.l_orderkey, (x - mu) / (sd + 1e-6) AS grpo, x - (tot - x) / (n - 1) AS rloo FROM u JOIN c USING (g) WHERE n > 1)
SELECT t.l_orderkey, pos, round(grpo * m + 1e-9, 5) AS grpo, round(rloo * m + 1e-9, 5) AS rloo FROM t JOIN a USING (l_orderkey)""")
def outcome_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of groups of several; groups of one are an error of both estimators."""
    df = _batch(spark, sf_dir)
    several = df.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uid")
    kept = df.join(several, "uid", "left_semi")
    grpo = advantage.ESTIMATORS["grpo"](kept).withColumnRenamed("advantages", "g").drop("returns")
    both = advantage.ESTIMATORS["rloo"](grpo)
    flat = both.select("l_orderkey", F.explode(F.arrays_zip("line", "g", "advantages")).alias("t"))
    return flat.select("l_orderkey", F.col("t.line").alias("pos"), F.round(F.col("t.g") + 1e-9, 5).alias("grpo"), F.round(F.col("t.advantages") + 1e-9, 5).alias("rloo"))


@query("""
WITH s AS (SELECT user_id, event_id, value AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.event_id, a.user_id, round(sum(b.r * power(0.9, b.i - a.i)) + 1e-7, 4) AS ret FROM s a JOIN s b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.i >= a.i GROUP BY ALL""")
def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole of every user's events."""
    out = advantage.discounted_rows(_events(spark, sf_dir), F.col("value"), "user_id", F.col("event_id"), gamma=0.9)
    return out.select("event_id", "user_id", F.round(F.col("ret") + 1e-7, 4).alias("ret"))


@query("""
WITH s AS (SELECT user_id, event_id, value AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
d AS (SELECT user_id, event_id, i, r, r + 0.9 * coalesce(lead(r * 0.5) OVER (PARTITION BY user_id ORDER BY i), 0) - r * 0.5 AS d FROM s),
g AS (SELECT a.event_id, any_value(a.r) AS r, sum(b.d * power(0.855, b.i - a.i)) AS x FROM d a JOIN d b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.i >= a.i GROUP BY a.event_id)
SELECT event_id, round(x + 1e-7, 4) AS adv, round(x + r * 0.5 + 1e-7, 4) AS ret FROM g""")
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole of every user's events."""
    out = advantage.gae_rows(_events(spark, sf_dir), F.col("value"), F.col("value") * 0.5, F.lit(1), "user_id", F.col("event_id"), gamma=0.9, lam=0.95)
    return out.select("event_id", F.round(F.col("advantage") + 1e-7, 4).alias("adv"), F.round(F.col("returns") + 1e-7, 4).alias("ret"))


@query("""
WITH k AS (SELECT *, (event_type = 'purchase')::INT AS m FROM events), s AS (SELECT sum(value * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM k),
v AS (SELECT sum(m * (value - mu) * (value - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS v FROM k, s)
SELECT event_id, round((value - mu) / sqrt(v + 1e-8), 6) AS white FROM k, s, v""")
def whiten_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = advantage.whiten_rows(_events(spark, sf_dir), F.col("value"), (F.col("event_type") == "purchase").cast("int"))
    return out.select("event_id", F.round("white", 6).alias("white"))


@query("""
SELECT event_id, user_id FROM (SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE m > 40 AND m < 60""")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage.with_group_stats(_events(spark, sf_dir), "value", "user_id").where((F.col("_avg") > 40) & (F.col("_avg") < 60)).select("event_id", "user_id")


@query("""
SELECT round(avg(n_chars), 6) AS mean_len, max(n_chars) AS max_len, min(n_chars) AS min_len, round(avg((n_chars = (SELECT max(n_chars) FROM documents))::INT), 6) AS clip_ratio FROM documents WHERE n_chars IS NOT NULL""")
def length_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.clip_ratio(table(spark, sf_dir, "documents").where(F.col("n_chars").isNotNull()), "n_chars")
    return m.select(F.round("mean_len", 6).alias("mean_len"), "max_len", "min_len", F.round("clip_ratio", 6).alias("clip_ratio"))


@query("""
SELECT event_type, round(sum(value * (user_id % 2)) / (sum(user_id % 2) + 1e-8), 6) AS m_mean, round(var_samp(CASE WHEN user_id % 2 = 1 THEN value END), 4) AS m_var FROM events GROUP BY event_type""")
def masked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.col("user_id") % 2
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(aggregates.masked_mean(F.col("value"), mask), 6).alias("m_mean"), F.round(aggregates.masked_var(F.col("value"), mask), 4).alias("m_var"))


@query("""
WITH p AS (SELECT user_id, sum(value * (event_type <> 'error')::INT) AS s, sum((event_type <> 'error')::INT) AS n FROM events GROUP BY user_id)
SELECT round(sum(s) / (sum(n) + 1e-8), 6) AS token_mean, round(avg(s / (n + 1e-8)), 6) AS seq_mean FROM p""")
def token_vs_seq_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.token_mean_and_sequence_mean(_events(spark, sf_dir), "user_id", F.col("value"), (F.col("event_type") != "error").cast("int"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("""
WITH a AS (SELECT l_returnflag, l_linestatus, l_suppkey, avg(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_linestatus, avg(q) AS q FROM a GROUP BY ALL)
SELECT l_returnflag, round(avg(q), 6) AS mean_q FROM b GROUP BY l_returnflag""")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.mean_of_means(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus", "l_suppkey")
    return m.select("l_returnflag", F.round("l_quantity", 6).alias("mean_q"))


@query("""
SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS w_price, round(sum(l_discount) / sum(l_tax), 6) AS ratio FROM lineitem GROUP BY l_returnflag""")
def weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(aggregates.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("w_price"), F.round(F.sum("l_discount") / F.sum("l_tax"), 6).alias("ratio"))


@query("""
WITH p AS (SELECT l_linenumber % 4 AS p, (l_orderkey % 4)::INT AS t FROM lineitem WHERE l_orderkey % 4 <> 3)
SELECT c AS cls, (SELECT count(*) FROM p WHERE p = c AND t = c) AS inter, (SELECT count(*) FROM p WHERE p = c) AS n_pred, (SELECT count(*) FROM p WHERE t = c) AS n_target,
  (SELECT count(*) FROM p WHERE p = c OR t = c) AS uni FROM (SELECT DISTINCT p AS c FROM p UNION SELECT DISTINCT t FROM p)""")
def confusion_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("int").alias("p"), (F.col("l_orderkey") % 4).cast("int").alias("t"))
    return aggregates.class_histogram(df, "p", "t", ignore=3)


@query("""
WITH c AS (SELECT o_orderkey % 50 AS inter, o_orderkey % 50 + o_custkey % 60 AS uni, o_custkey % 7 AS target_area, o_orderkey % 5 AS pred_area FROM orders)
SELECT round(avg(CASE WHEN target_area = 0 THEN (pred_area = 0)::INT END) * 100, 2) AS n_acc, round(avg(CASE WHEN target_area <> 0 THEN (pred_area > 0)::INT END) * 100, 2) AS t_acc,
  round(avg(CASE WHEN target_area = 0 THEN (pred_area = 0)::INT WHEN uni > 0 THEN inter / uni ELSE 0 END) * 100, 2) AS g_iou, round(sum(inter) / sum(uni) * 100, 2) AS c_iou FROM c""")
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    cases = table(spark, sf_dir, "orders").select((o % 50).alias("inter"), (o % 50 + c % 60).alias("uni"), (c % 7).alias("target_area"), (o % 5).alias("pred_area"))
    m = aggregates.segmentation_metrics(cases)
    return m.select(*[F.round(c, 2).alias(c) for c in m.columns])


@query("""
WITH m AS (SELECT user_id, max(value) AS best FROM events GROUP BY user_id) SELECT round(avg((best >= 99)::INT) * 100, 4) AS ap, round(avg(best), 6) AS mean_best FROM m""")
def max_then_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = aggregates.best_per_case(_events(spark, sf_dir), "user_id", "value")
    return aggregates.share_at_least(best, "value", 99).select(F.round(F.col("share") * 100, 4).alias("ap"), F.round("mean", 6).alias("mean_best"))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT a.d::INT AS i, b.d::INT AS j, round(avg(a.x), 6) AS mean_i, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.d <= b.d GROUP BY ALL""")
def covariance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.feature_statistics(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("i", "j", F.round("mean_i", 6).alias("mean_i"), F.round("cov", 6).alias("cov"))


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.keep_last(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])



@query("""
WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
SELECT label, d::INT AS dim, count(*) AS n, round(avg(x), 6) AS m FROM f GROUP BY ALL""")
def codebook_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.codebook_update(table(spark, sf_dir, "embeddings").select("label", "embedding"), "label", "embedding")
    return out.select("label", "n", F.posexplode("mean").alias("dim", "m")).select("label", (F.col("dim") + 1).alias("dim"), "n", F.round("m", 6).alias("m"))


@query("""
WITH s AS (SELECT vec_id, label % 10 AS y, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS n FROM s)
SELECT round(sum((n <= 3 AND i = y)::INT) * 100.0 / count(DISTINCT vec_id), 4) AS top3 FROM r""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = aggregates.top_k_accuracy(F.col("embedding"), F.col("label") % 10, 3)
    return table(spark, sf_dir, "embeddings").agg(F.round(F.sum(hit) * 100 / F.count(F.lit(1)), 4).alias("top3"))


@query("SELECT round(1 - var_samp(l_extendedprice - l_quantity * 1000) / (var_samp(l_extendedprice) + 1e-5), 6) AS ev FROM lineitem")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(aggregates.explained_variance(F.col("l_extendedprice"), F.col("l_quantity") * 1000), 6).alias("ev"))


@query("""
WITH s AS (SELECT event_id, user_id, value / 10 AS v, max(value / 10) OVER (PARTITION BY user_id) AS m FROM events)
SELECT event_id, round(exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY user_id), 6) AS p FROM s""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage.group_softmax(_events(spark, sf_dir).withColumn("v", F.col("value") / 10), "v", "user_id").select("event_id", F.round("p", 6).alias("p"))


@query("""
SELECT event_id, (coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS mask,
  greatest(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1, 0)::BIGINT AS pos FROM events""")
def eos_mask_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("event_id")
    done = advantage.up_to_first(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), (F.col("event_type") == "purchase").cast("int"), "user_id", o)
    return advantage.position_ids(done, (F.col("event_type") != "error").cast("int"), "user_id", o).select("event_id", "mask", "pos")


@query("""
SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 6) AS k1, round(abs(l_discount - l_tax), 6) AS k2, round(0.5 * (l_discount - l_tax) * (l_discount - l_tax), 6) AS k3,
  round(least(greatest(exp(l_tax - l_discount) - (l_tax - l_discount) - 1, -10), 10), 6) AS k4, round(l_extendedprice / 1000 - 0.1 * (l_discount - l_tax), 6) AS reward FROM lineitem""")
def kl_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(advantage.kl(a, b, k), 6).alias(n) for n, k in (("k1", "kl"), ("k2", "abs"), ("k3", "mse"), ("k4", "low_var_kl"))], F.round(F.col("l_extendedprice") / 1000 - advantage.kl(a, b) * 0.1, 6).alias("reward"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, exp(l_discount * 10 - l_tax * 10) AS r, l_quantity - 25 AS a FROM lineitem), u AS (SELECT *, greatest(-a * r, -a * least(greatest(r, 0.8), 1.28)) AS up FROM t)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a < 0 THEN least(-a * 3, up) ELSE up END, 5) AS loss FROM u""")
def policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(advantage.clipped_policy_loss(F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") - 25), 5).alias("loss"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS p, l_linenumber * 5.0 AS y, 20.0 AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.5 * greatest((p - y) * (p - y), (least(greatest(p, o - 0.5), o + 0.5) - y) * (least(greatest(p, o - 0.5), o + 0.5) - y)), 6) AS loss FROM t""")
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(advantage.clipped_value_loss(F.col("l_quantity"), F.col("l_linenumber") * 5.0, F.lit(20.0)), 6).alias("loss"))


@query("""
SELECT (l_orderkey % 16)::INT AS y, (l_partkey % 16)::INT AS x, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS v FROM lineitem GROUP BY ALL""")
def tile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x")).agg(F.round(aggregates.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("v"))


@query("""
SELECT vec_id, round(embedding[(label % 8) + 1] - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS lp FROM embeddings""")
def log_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.log_prob(logits, F.col("label") % 8), 6).alias("lp"))


@query("""
WITH p AS (SELECT o_custkey % 8 AS part, sum(o_orderkey % 1000) AS s FROM orders GROUP BY 1) SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS most, (max(s) - min(s))::BIGINT AS diff FROM p""")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("part"), (F.col("o_orderkey") % 1000).alias("size"))
    return balance.imbalance(df, "part", "size")


@query()
def kk_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("bigint").alias("size"))
    return balance.balance(df, "size", 8, "o_orderkey").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
