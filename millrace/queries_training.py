"""Queries: losses and metrics of batches, labels, judge answers, balancing, named tensors, referring expressions, media plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, media, rewards, text
from millrace.operators import advantage, aggregates, balance, batch, joins, tensors
from millrace.registry import query
from millrace.runtime import table

_T = """t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l, o, n, a, m) - 1 AS pos FROM (
  SELECT l_orderkey AS k, l_linenumber AS l, l_tax * 10 AS o, l_discount * 10 AS n, (l_quantity - 25) / 10 AS a, (l_returnflag <> 'R')::INT AS m FROM lineitem))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence per order: old and new log-probabilities, advantages and mask of its lines."""
    row = F.struct(F.col("l_linenumber").alias("l"), (F.col("l_tax") * 10).alias("o"), (F.col("l_discount") * 10).alias("n"), ((F.col("l_quantity") - 25) / 10).alias("a"), (F.col("l_returnflag") != "R").cast("int").alias("m"))
    seq = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("s"))
    pick = lambda c: F.transform("s", lambda x: x[c].cast("double"))
    return seq.select("k", pick("o").alias("o"), pick("n").alias("n"), pick("a").alias("a"), F.transform("s", lambda x: x["m"]).alias("m"))


_RATIO = {"default": "n - o", "gspo": "s * m", "gspo_token": "s", "cispo": "n - o"}


def _objective_sql(kind: str, mode: str) -> str:
    loss = "-a * n * c" if kind == "cispo" else "CASE WHEN a < 0 THEN least(greatest(-a * r, -a * c), -a * 3) ELSE greatest(-a * r, -a * c) END"
    mean = lambda x: f"sum({x} * m) / (sum(m) + 1e-8)" if mode == "token" else f"avg({x}_q)"
    clipped = "" if kind == "cispo" else ", round(sum(hi * m) / (sum(m) + 1e-8), 6) AS clipped_higher, round(sum(lo * m) / (sum(m) + 1e-8), 6) AS clipped_lower"
    seq = "q AS (SELECT k, sum(loss * m) / (sum(m) + 1e-8) AS loss_q, sum(-n * m) / (sum(m) + 1e-8) AS ent_q FROM l GROUP BY k)"
    means = f"round({mean('loss')}, 6) AS loss, round({mean('ent')}, 6) AS entropy" if mode == "token" else "round((SELECT avg(loss_q) FROM q), 6) AS loss, round((SELECT avg(ent_q) FROM q), 6) AS entropy"
    return f"""
WITH {_T}, g AS (SELECT *, sum((n - o) * m) OVER w / (sum(m) OVER w + 1e-8) AS s FROM t WINDOW w AS (PARTITION BY k)),
r AS (SELECT *, exp(least(greatest({_RATIO[kind]}, -20), 20)) AS r, exp(least(greatest({_RATIO[kind]}, ln(0.8)), ln(1.28))) AS c FROM g),
l AS (SELECT *, {loss} AS loss, -n AS ent, (-a * r < -a * c)::INT AS hi, (greatest(-a * r, -a * c) > -a * 3 AND a < 0)::INT AS lo FROM r), {seq}
SELECT {means}, round(sum(-(n - o) * m) / (sum(m) + 1e-8), 6) AS kl{clipped} FROM l"""


def _objective(kind: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = advantage.policy_objective(_lines(spark, sf_dir), "o", "n", "a", "m", kind, mode)
        return out.select(*[F.round(c, 6).alias(c) for c in out.columns])

    run.__name__ = f"policy_objective_{kind}_{mode}"
    return run


for _k, _m in (("default", "token"), ("default", "seq"), ("gspo", "token"), ("gspo_token", "seq"), ("cispo", "token")):
    query(_objective_sql(_k, _m))(_objective(_k, _m))


@query("""
WITH t AS (SELECT l_orderkey AS k, l_quantity AS p, l_linenumber * 5.0 AS y, 20.0 AS o, (l_returnflag <> 'R')::INT AS m FROM lineitem),
u AS (SELECT *, (p - y) * (p - y) AS a, (least(greatest(p, o - 0.5), o + 0.5) - y) * (least(greatest(p, o - 0.5), o + 0.5) - y) AS b FROM t)
SELECT round(sum(0.5 * greatest(a, b) * m) / (sum(m) + 1e-8), 6) AS loss, round(sum((a < b)::INT * m) / (sum(m) + 1e-8), 6) AS clipped, round(sum(p * m) / (sum(m) + 1e-8), 6) AS mean_pred FROM u""")
def value_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = (F.col("l_returnflag") != "R").cast("int")
    out = advantage.value_objective(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_linenumber") * 5.0, F.lit(20.0), mask)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""
WITH {_T}, d AS (SELECT *, (n - o) * m AS d FROM t), q AS (SELECT sum(d) / (sum(m) + 1e-8) AS x FROM d GROUP BY k)
SELECT (SELECT round(avg(x), 6) FROM q) AS current_kl, round(sum(a - 0.1 * d), 4) AS total FROM d""")
def kl_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mean = advantage.kl_penalised(_lines(spark, sf_dir), "a", "n", "o", "m", 0.1)
    total = out.agg(F.round(F.sum(F.aggregate("rewards", F.lit(0.0), lambda s, x: s + x)), 4).alias("total"))
    return mean.select(F.round("current_kl", 6).alias("current_kl")).join(F.broadcast(total), F.lit(True))  # one row each


@query("""
WITH t AS (SELECT l_orderkey AS k, l_tax AS s, l_discount AS r, l_quantity AS a, l_extendedprice / 1000 AS g, l_quantity * 2 AS v, l_returnflag <> 'R' AS m FROM lineitem),
q AS (SELECT sum(s) AS s, sum(r) AS r FROM t GROUP BY k), o AS (SELECT * FROM t WHERE m)
SELECT (SELECT round(avg(s), 6) FROM q) AS score_mean, (SELECT round(max(s), 6) FROM q) AS score_max, (SELECT round(min(s), 6) FROM q) AS score_min, (SELECT round(avg(r), 6) FROM q) AS rewards_mean, (SELECT round(max(r), 6) FROM q) AS rewards_max,
  (SELECT round(min(r), 6) FROM q) AS rewards_min, round(avg(a), 6) AS advantages_mean, round(max(a), 6) AS advantages_max, round(min(a), 6) AS advantages_min, round(avg(g), 6) AS returns_mean, round(max(g), 6) AS returns_max, round(min(g), 6) AS returns_min,
  round(avg(v), 6) AS values_mean, round(max(v), 6) AS values_max, round(min(v), 6) AS values_min, round(1 - var_samp(g - v) / (var_samp(g) + 1e-5), 6) AS explained_variance FROM o""")
def data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = aggregates.data_metrics(
        table(spark, sf_dir, "lineitem"), "l_orderkey", c("l_tax"), c("l_discount"), c("l_quantity"), c("l_extendedprice") / 1000, (c("l_returnflag") != "R").cast("int"), c("l_quantity") * 2,
    )
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query("SELECT event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY 1")
def reduce_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reduce_metrics(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value"), "key", "value").select("key", F.round("value", 6).alias("value"))


_CONV = "(SELECT conv_id, any_value(input_ids) AS ids, any_value(num_tokens) AS num_tokens FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.first("input_ids").alias("ids"))


@query(f"SELECT conv_id, len(ids)::INT AS n FROM {_CONV} WHERE coalesce(len(ids), 0) <= 512")
def within_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.within_length(_ids(spark, sf_dir), "ids", 512).select("conv_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"))


@query()
def role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of whole sequences with a header put behind every mask token, so that the rule has answers to find."""
    marked = F.flatten(F.transform("ids", lambda x: F.when(x % 11 == 0, F.array(F.lit(77091).cast("bigint"), F.lit(198).cast("bigint"), x)).when(x % 13 == 0, F.array(F.lit(151645).cast("bigint"), x)).otherwise(F.array(x))))
    df = _ids(spark, sf_dir).where(F.col("ids").isNotNull()).select("conv_id", marked.alias("ids"))
    return df.select("conv_id", arrays.role_labels(F.col("ids")).alias("labels"))


@query("""
WITH t AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'Image 1: ' || user_id % 9 || '.5 and Image 2: ' || user_id % 4 WHEN 'view' THEN '{"score": [' || user_id % 9 || ', "' || user_id % 4 || ' of 9"], "reasoning": "r"}' ELSE 'Image 2 is better' END AS x, event_type FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN (user_id % 9)::DOUBLE END AS editing_success, CASE WHEN event_type = 'view' THEN (user_id % 4)::DOUBLE END AS overediting, CASE WHEN event_type = 'view' THEN (user_id % 9 + user_id % 4) / 2.0 END AS score,
  CASE WHEN event_type = 'view' THEN 'r' END AS reasoning, CASE WHEN event_type = 'click' THEN user_id % 9 + 0.5 END::DOUBLE AS image_1_score, CASE WHEN event_type = 'click' THEN user_id % 4 END::DOUBLE AS image_2_score,
  CASE WHEN event_type NOT IN ('view', 'click') THEN 'Edited image 2' END AS winner FROM t""")
def judge_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_type")
    s = lambda c: c.cast("string")
    said = (
        F.when(e == "click", F.concat(F.lit("Image 1: "), s(u % 9), F.lit(".5 and Image 2: "), s(u % 4)))
        .when(e == "view", F.concat(F.lit('{"score": ['), s(u % 9), F.lit(', "'), s(u % 4), F.lit(' of 9"], "reasoning": "r"}'))).otherwise("Image 2 is better")
    )
    task = F.when(e == "click", text.JUDGE_TASKS[1]).when(e == "view", text.JUDGE_TASKS[0]).otherwise(text.JUDGE_TASKS[2])
    return table(spark, sf_dir, "events").select("event_id", text.judge_output(said, task).alias("j")).select("event_id", "j.*")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN ['Quality', 'Alignment'] WHEN 'view' THEN ['Aesthetics'] ELSE ['Quality', 'Aesthetics', 'Alignment', 'Real-world Fidelity', 'Creative Generation'] END AS dims FROM events""")
def asked_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_type") == "click", "Quality / Realism / Noise; Alignment / Color; Quality / Detail").when(F.col("event_type") == "view", "Aesthetics")
    return table(spark, sf_dir, "events").select("event_id", text.asked_dimensions(asked).alias("dims"))


@query()
def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of the conversations scored against the one before it, as a plain source."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.first("conversations").alias("c"))
    both = c.select("conv_id", F.inline(F.transform("c", lambda m, i: F.struct(i.alias("n"), m["value"].alias("a"), F.get("c", i - 1)["value"].alias("b")))))
    kept = both.where(F.col("a").contains("<|mt_") & F.col("b").isNotNull())
    return kept.select("conv_id", "n", rewards.score(F.lit("res"), F.col("a"), F.col("b")).alias("s")).select("conv_id", "n", F.round("s.overall", 6).alias("overall"), F.round("s.accuracy", 6).alias("accuracy"), "s.no_repeat")


@query()
def dynamic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000 + 1).alias("size"))
    out = balance.dynamic_batches(df, "size", 8192, "o_orderkey")
    return out.groupBy("batch", "micro").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


@query("SELECT n_nationkey AS pos, (24 - n_nationkey)::BIGINT AS idx FROM nation")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.reverse_index(table(spark, sf_dir, "nation").select((24 - F.col("n_nationkey")).cast("bigint").alias("pos"), F.col("n_nationkey").alias("idx")))


@query("""
WITH o AS (SELECT o_orderkey % 1000 AS s, o_custkey % 8 AS p, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders), n AS (SELECT count(*) AS n FROM orders),
b AS (SELECT sum(s) AS s FROM o, n GROUP BY rid // (n // 8)), a AS (SELECT sum(s) AS s FROM o GROUP BY p)
SELECT (SELECT min(s) FROM b)::BIGINT AS least, (SELECT max(s) FROM b)::BIGINT AS most, (SELECT max(s) - min(s) FROM b)::BIGINT AS diff, (SELECT min(s) FROM a)::BIGINT AS balanced_least, (SELECT max(s) FROM a)::BIGINT AS balanced_most, (SELECT sum(s) FROM b) / 8 AS mean""")
def imbalance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = batch.row_ids(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("s"), (F.col("o_custkey") % 8).alias("p")), "o_orderkey")
    return balance.imbalance_report(df, "_rid", "p", "s", df.count(), 8)


_REF1 = "(SELECT ref_id, any_value(ann_id) AS ann_id, any_value(image_id) AS image_id, any_value(split) AS split, any_value(sentences) AS sentences FROM refs WHERE ref_id IS NOT NULL GROUP BY ref_id)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "refs").where("ref_id IS NOT NULL").dropDuplicates(["ref_id"])


@query(f"""
WITH i AS (SELECT id, any_value(file_name) AS f FROM images WHERE id IS NOT NULL AND file_name IS NOT NULL GROUP BY id)
SELECT ref_id, '/data/' || f AS image, lower(trim(s.sent)) AS phrase, ann_id AS ann_ids, ann_id = [-1] AS no_target FROM (SELECT ref_id, ann_id, image_id, unnest(sentences) AS s FROM {_REF1} WHERE split = 'val') JOIN i ON i.id = image_id""")
def evaluation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "images").where("id IS NOT NULL AND file_name IS NOT NULL").dropDuplicates(["id"])
    return joins.evaluation_items(_refs(spark, sf_dir), images, "val", "/data")


@query(f"""
WITH a AS (SELECT DISTINCT id, image_id FROM annotations WHERE id IS NOT NULL), r AS (SELECT DISTINCT unnest(ann_id) AS id FROM {_REF1} WHERE ref_id IN (SELECT ref_id FROM {_REF1} ORDER BY ref_id LIMIT 200))
SELECT DISTINCT a.id FROM a JOIN r USING (id)""")
def annotation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    asked = [r["ref_id"] for r in refs.orderBy("ref_id").limit(200).select("ref_id").collect()]  # the list a user asks for
    return joins.annotation_ids(table(spark, sf_dir, "annotations").where("id IS NOT NULL"), refs, ref_ids=asked)


@query("SELECT DISTINCT id FROM images")
def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.image_ids(table(spark, sf_dir, "images"), table(spark, sf_dir, "refs"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"""
SELECT a.vec_id, list(round({_DOT} / {_NORM.format('a')} / {_NORM.format('b')}, 5) ORDER BY b.vec_id) AS sims FROM embeddings a JOIN embeddings b ON b.vec_id < 16 GROUP BY a.vec_id""")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against a reference set of sixteen."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = joins.similarity_matrix(e, e.where("vec_id < 16"), "vec_id", "embedding")
    return out.select("vec_id", F.transform("sims", lambda x: F.round(x, 5)).alias("sims"))


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of low-rank factors: a name per part, a row per supplier's parity."""
    base = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("file")).select("p_partkey", "p_size", "file", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"))
    name = F.concat(F.lit("blocks."), F.col("p_partkey").cast("string"), F.lit(".lora_"), "side", F.lit(".weight"))
    k = F.col("p_size").cast("double")
    return base.select("file", name.alias("name"), F.when(F.col("side") == "A", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1))).alias("shape"), F.array(k + F.col("file"), k * 2 + F.col("file")).alias("data"))


@query("""
SELECT 'blocks.' || p_partkey || '.lora_A.weight' AS name, [2, 2] AS shape, [p_size * 0.5, p_size * 1.0, (p_size + 1) * 0.5, (p_size * 2 + 1) * 0.5]::DOUBLE[] AS data FROM part
UNION ALL SELECT 'blocks.' || p_partkey || '.lora_B.weight', [2, 2], [p_size, p_size + 1, p_size * 2, p_size * 2 + 1]::DOUBLE[] FROM part""")
def merge_low_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.merge_low_rank(_tensors(spark, sf_dir), 0.5)


@query("""
SELECT 'blocks.' || p_partkey || '.lora_' || s || '.default.weight' AS name, (p_size + 1)::DOUBLE AS first FROM part, (SELECT unnest(['A', 'B']) AS s)""")
def low_rank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tensors.low_rank_names(tensors.load_files(_tensors(spark, sf_dir)))
    return named.select("name", F.get("data", F.lit(0)).alias("first"))


@query("SELECT p_partkey || '.weight' AS name, p_size::DOUBLE AS first FROM part")
def trainable_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.lit(0).alias("file"), F.concat(F.lit("model."), F.col("p_partkey").cast("string"), F.lit(".weight")).alias("name"), F.array(F.lit(1)).alias("shape"), F.array(F.col("p_size").cast("double")).alias("data"))
    return tensors.trainable(t.unionByName(t.withColumn("name", F.concat("name", F.lit("_frozen")))), t.select("name"), "model.").select("name", F.get("data", F.lit(0)).alias("first"))


@query("""
SELECT p_partkey, (greatest(1, (p_size + 22 - 5) // 17) * 17 + 5)::INT AS used, floor((p_size + 22) / (p_size % 5 + 20.0) * 16)::INT AS available, (p_size * 100)::BIGINT AS first, least(p_size * 100 + 250, 4000)::BIGINT AS last FROM part WHERE p_size * 100 <= 4000""")
def media_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame groups of the form 17n+5, frames at another rate, and sample ranges of a track of 4,000 samples."""
    n, rate = F.col("p_size") + 22, F.col("p_size") % 5 + 20.0
    span = media.sample_range(F.lit(100.0), F.col("p_size").cast("double"), 2.5, F.lit(4000))
    df = table(spark, sf_dir, "part").where(F.col("p_size") * 100 <= 4000)
    return df.select("p_partkey", media.grouped_frames(n, 17, 5).alias("used"), media.available_frames(n, None, rate, 16.0).alias("available"), span.alias("s")).select("p_partkey", "used", "available", "s.first", "s.last")


@query("""
WITH t AS (SELECT conv_id, len(ids) AS n FROM """ + _CONV + """ WHERE len(ids) > 0), k AS (SELECT conv_id, n, unnest(range(4)) AS part FROM t)
SELECT conv_id, part::INT AS part, ceil(n / 4)::INT AS size FROM k""")
def sequence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences cut into four padded parts."""
    parts = batch.sequence_parts(_ids(spark, sf_dir).where(F.size("ids") > 0), "ids", 4, F.lit(0).cast("bigint"))
    return parts.select("conv_id", "part", F.size("ids").alias("size"))


@query("""
SELECT y::INT AS y, x::INT AS x, round(sum(v * w) / sum(w), 6) AS v FROM (
  SELECT h.a + i AS y, g.a + j AS x, (h.a + g.a + i * j)::DOUBLE AS v,
    greatest(1, least(8, CASE WHEN h.a = 0 THEN 8 ELSE i + 1 END, CASE WHEN h.b >= 40 THEN 8 ELSE 16 - i END, CASE WHEN g.a = 0 THEN 8 ELSE j + 1 END, CASE WHEN g.b >= 40 THEN 8 ELSE 16 - j END)) / 8 AS w
  FROM (VALUES (0, 16), (12, 28), (24, 40)) h(a, b), (VALUES (0, 16), (12, 28), (24, 40)) g(a, b), range(16) r(i), range(16) s(j)) GROUP BY ALL""")
def tile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles of a field of 40 by 40 blended with their border weights."""
    starts = aggregates.tile_starts(40, 16, 12)
    parts = []
    for a, b in starts:
        for c, d in starts:
            grid = spark.range(256).select(F.floor(F.col("id") / 16).cast("int").alias("i"), (F.col("id") % 16).cast("int").alias("j"))
            w = aggregates.blend_weight(F.col("i"), F.col("j"), 16, 16, (a == 0, b >= 40, c == 0, d >= 40))
            parts.append(grid.select((F.col("i") + a).alias("y"), (F.col("j") + c).alias("x"), (F.col("i") * F.col("j") + a + c).cast("double").alias("v"), w.alias("w")))
    return aggregates.blend_tiles(batch.concat(parts), "v", "w", "y", "x").select("y", "x", F.round("v", 6).alias("v"))


@query("SELECT count(*) AS rows, sum(coalesce(len(ids), 0) * 8)::BIGINT AS bytes FROM " + _CONV)
def table_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.table_bytes(_ids(spark, sf_dir), "ids")


@query("SELECT n_nationkey, w::INT AS worker FROM nation, (SELECT unnest(range(3)) AS w)")
def replicate_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.replicate_to_all(table(spark, sf_dir, "nation").select("n_nationkey"), 3)


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT 9, 99, 'x' WHERE false")
def rename_and_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename, pop, join back and put two halves together again."""
    df = batch.row_ids(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    popped, rest = batch.pop(batch.rename(df, ["n_name"], ["label"]), "label")
    whole = batch.column_union(rest, popped)
    halves = [whole.where("_rid < 12"), batch.unpad(whole.where("_rid >= 12"), 30, 5)]
    return batch.rename(batch.select_existing(batch.concat(halves), "n_regionkey", "n_nationkey", "label", "absent"), ["label"], ["n_name"])


@query("SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY user_id")
def user_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of one's own: a value per row, reduced per user."""

    class PerUser(aggregates.ColumnMetric):
        def reduce(self, scored: DataFrame) -> DataFrame:
            return scored.groupBy("user_id").agg(F.round(F.avg(self.name), 6).alias(self.name))

    return PerUser("value", F.col("value")).compute(table(spark, sf_dir, "events").drop("ts"))


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"Realism": {"Noise": {"score": ' || p_size % 3 || '}, "Feature Mapping": {"score": "N/A"}}}' ELSE '{"Noise": {"score": ' || p_size % 3 || '}}' END AS x, p_size FROM part)
SELECT p_partkey, 'Quality' AS l1, 'Detail' AS l2, 'Noise' AS l3, [0.0, 60.0, 100.0][p_size % 3 + 1]::DOUBLE AS score FROM t UNION ALL SELECT p_partkey, 'Quality', 'Feature', 'Feature Matching', NULL FROM t WHERE p_size % 2 = 0""")
def bench_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("p_size") % 3).cast("string")
    nested = F.concat(F.lit('{"Realism": {"Noise": {"score": '), s, F.lit('}, "Feature Mapping": {"score": "N/A"}}}'))
    said = F.when(F.col("p_size") % 2 == 0, nested).otherwise(F.concat(F.lit('<think>x</think>{"Noise": {"score": '), s, F.lit("}}")))
    df = table(spark, sf_dir, "part").select("p_partkey", F.lit("Quality").alias("dim"), said.alias("t"))
    return aggregates.bench_scores(df, "p_partkey", "dim", "t", {"Noise": "Detail", "Feature Matching": "Feature"}, {"Feature Mapping": "Feature Matching"})[0]


@query("""
WITH b AS (SELECT vec_id AS code, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE vec_id < 16), k AS (SELECT vec_id, label % 16 AS a, vec_id % 20 AS c FROM embeddings),
u AS (SELECT vec_id, a AS code FROM k UNION ALL SELECT vec_id, c FROM k), s AS (SELECT vec_id, d, round(sum(x), 5) AS x FROM u JOIN b USING (code) GROUP BY vec_id, d)
SELECT vec_id, list(x ORDER BY d) AS embedding FROM s GROUP BY vec_id""")
def embed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codes a row; codes of 16 and more are not in the codebook."""
    e = table(spark, sf_dir, "embeddings")
    codes = e.select("vec_id", F.array((F.col("label") % 16).cast("bigint"), (F.col("vec_id") % 20).cast("bigint")).alias("codes"))
    book = e.where("vec_id < 16").select(F.col("vec_id").alias("code"), F.transform("embedding", lambda x: x.cast("double")).alias("cvec"))
    return joins.embed_codes(codes, "vec_id", "codes", book).select("vec_id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query(f"SELECT conv_id, coalesce(num_tokens, 1)::INT AS n FROM {_CONV}")
def known_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths told in the table, 1 where none is."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.first("num_tokens").alias("n"))
    return c.select("conv_id", F.coalesce("n", F.lit(1)).alias("n"))


@query()
def media_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of whole sequences in which a grid of one frame of two by two patches stands at the first image token."""
    grid = F.array(F.struct(F.lit(1).alias("t"), F.lit(2).alias("h"), F.lit(2).alias("w")))
    df = _ids(spark, sf_dir).where(F.size("ids") > 0)
    return df.select("conv_id", F.size("ids").alias("n"), arrays.grid_positions(arrays.media_segments(F.col("ids"), grid), timed=True).alias("p"))
