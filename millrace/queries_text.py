"""Queries: text, JSON, conversations, rewards, sizes, masks and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, rewards, text
from millrace.registry import query
from millrace.runtime import table

_MASK_RE = r"(<\|mt_start\|><\|mt_\d{4}\|><\|mt_\d{4}\|><\|mt_end\|>)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select("conv_id", "image", "conversations", "input_ids").dropDuplicates(["conv_id"])


_CONV = "(SELECT conv_id, any_value(image) AS image, any_value(conversations) AS conversations, any_value(input_ids) AS input_ids FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"
_WORDS = r"CASE WHEN trim(regexp_replace(coalesce(x.value, ''), '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(x.value, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g')), ' ')) END"
_TURNS = '(SELECT conv_id, unnest(conversations) AS t, generate_subscripts(conversations, 1) AS n FROM ' + _CONV + ')'


@query(f"""
SELECT conv_id, (coalesce(list_sum(list_transform(conversations, lambda x: {_WORDS})), 0) + CASE WHEN image IS NULL THEN 0 ELSE 128 END)::INT AS n_words FROM {_CONV}""")
def conversation_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", text.conversation_words(F.col("conversations"), F.col("image")).alias("n_words"))


@query(f"""
SELECT conv_id, (coalesce(list_sum(list_transform(conversations, lambda x: {_WORDS})), 0) * CASE WHEN image IS NULL THEN -1 ELSE 1 END)::INT AS n_words FROM {_CONV}""")
def modality_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", text.signed_length(text.conversation_words(F.col("conversations")), F.col("image")).alias("n_words"))


@query(f"""
SELECT conv_id, (n - 1)::INT AS pos, CASE WHEN lower(trim(t."from")) IN ('human', 'user') THEN 'user' WHEN lower(trim(t."from")) IN ('gpt', 'assistant') THEN 'assistant' ELSE lower(trim(t."from")) END AS role, t.value AS value FROM {_TURNS}""")
def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json("conversations", {"ignoreNullFields": "false"})
    msgs = _conversations(spark, sf_dir).where(F.col("conversations").isNotNull()).select("conv_id", F.posexplode(text.normalise_messages(raw)).alias("pos", "m"))
    return msgs.select("conv_id", "pos", text.chat_role(F.col("m.from")).alias("role"), F.col("m.value").alias("value"))


@query(f"""
SELECT conv_id, len(CASE WHEN lower(conversations[1]."from") IN ('human', 'user') THEN conversations ELSE conversations[2:] END)::INT AS n_turns FROM {_CONV} WHERE conversations IS NOT NULL""")
def drop_leading_non_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).where(F.col("conversations").isNotNull()).select("conv_id", F.size(text.drop_leading_answer(F.col("conversations"))).alias("n_turns"))


@query("""SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
SELECT conv_id, n::INT AS n, list_transform(regexp_extract_all(t.value, '<\\|mt_(\\d{{4}})\\|>', 1), lambda x: x::INT) AS codes, len(regexp_extract_all(t.value, '{_MASK_RE}'))::INT AS n_masks,
  (len(list_filter(list_distinct(regexp_extract_all(t.value, '{_MASK_RE}')), lambda m: len(list_filter(regexp_extract_all(t.value, '{_MASK_RE}'), lambda y: y = m)) > 3)) = 0)::INT::DOUBLE AS fresh
FROM {_TURNS} WHERE t.value IS NOT NULL""")
def mask_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _conversations(spark, sf_dir).select("conv_id", F.posexplode("conversations").alias("n", "t")).where(F.col("t.value").isNotNull())
    v = F.col("t.value")
    return t.select("conv_id", (F.col("n") + 1).alias("n"), rewards.code_ids(v).alias("codes"), F.size(rewards.masks(v)).alias("n_masks"), rewards.non_repeat_reward(v).alias("fresh"))


@query(f"""
WITH t AS (SELECT conv_id, (n - 1)::INT AS n, t.value AS v FROM {_TURNS} WHERE t.value LIKE '%<|mt_%'),
a AS (SELECT conv_id, n, regexp_replace(v, '(<\\|mt_start\\|>)(<\\|mt_\\d+\\|>)(<\\|mt_\\d+\\|>)(?:<\\|mt_\\d+\\|>)+<\\|mt_end\\|>', '\\1\\2\\3<|mt_end|>', 'g') AS v FROM t),
b AS (SELECT conv_id, n, regexp_replace(v, '(<\\|mt_start\\|>)(<\\|mt_\\d+\\|>)(<\\|mt_end\\|>)', '\\1\\2<|mt_9999|><|mt_end|>', 'g') AS v FROM a)
SELECT conv_id, n, regexp_replace(v, '(?s)(<\\|mt_start\\|>)(<\\|mt_\\d+\\|>)([^<]|<[^|]|<\\|[^m]|<\\|m[^t]|<\\|mt[^_]|(?:<(?:\\|(?:m(?:t)?)?)?)?$)', '\\1\\2<|mt_9999|><|mt_end|>\\3', 'g') AS fixed FROM b""")
def repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _conversations(spark, sf_dir).select("conv_id", F.posexplode("conversations").alias("n", "t")).where(F.col("t.value").contains("<|mt_"))
    return t.select("conv_id", "n", rewards.repair(F.col("t.value")).alias("fixed"))


@query(f"""
WITH a AS (SELECT conv_id, n, t.value AS v FROM {_TURNS} WHERE t.value LIKE '%<|mt_end|>%'),
p AS (SELECT conv_id, n, regexp_extract_all(v, '{_MASK_RE}') AS p, lead(regexp_extract_all(v, '{_MASK_RE}')) OVER (PARTITION BY conv_id ORDER BY n) AS t FROM a),
g AS (SELECT conv_id, n, greatest(len(p), len(t)) AS most, list_transform(list_distinct(p), lambda x: list_max(list_transform(t, lambda y:
  CASE WHEN x = y THEN 1.0 WHEN left(x, 36) = left(y, 36) THEN 0.8 WHEN left(x, 24) = left(y, 24) THEN 0.4 ELSE 0.0 END))) AS s FROM p WHERE t IS NOT NULL)
SELECT conv_id, n::INT AS n, round(CASE WHEN most = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(s, lambda z: coalesce(z, 0.0))), 0.0) / most END, 6)::DOUBLE AS reward FROM g""")
def grade_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = _conversations(spark, sf_dir).select("conv_id", F.posexplode("conversations").alias("n", "t")).where(F.col("t.value").contains("<|mt_end|>"))
    p = a.select("conv_id", (F.col("n") + 1).alias("n"), F.col("t.value").alias("v")).withColumn("w", F.lead("v").over(Window.partitionBy("conv_id").orderBy("n")))
    return p.where(F.col("w").isNotNull()).select("conv_id", "n", F.round(rewards.mask_token_reward(F.col("v"), F.col("w")), 6).alias("reward"))


_RESPONSES = "(SELECT event_id, CASE event_type WHEN 'click' THEN '<think>a' || event_id || '</think> <answer>b' || user_id || '</answer>' WHEN 'view' THEN 'x' || event_id || '<answer>y' WHEN 'error' THEN 'u' || event_id || '</think>w' ELSE 'plain ' || event_id END AS r FROM events)"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_type")
    r = (
        F.when(k == "click", F.concat(F.lit("<think>a"), e, F.lit("</think> <answer>b"), F.col("user_id").cast("string"), F.lit("</answer>")))
        .when(k == "view", F.concat(F.lit("x"), e, F.lit("<answer>y"))).when(k == "error", F.concat(F.lit("u"), e, F.lit("</think>w"))).otherwise(F.concat(F.lit("plain "), e))
    )
    return table(spark, sf_dir, "events").select("event_id", r.alias("r"))


@query(f"""
SELECT event_id, CASE WHEN regexp_matches(r, '(?s)<think>.*?</think>') THEN regexp_extract(r, '(?s)<think>(.*?)</think>', 1) WHEN contains(r, '<answer>') THEN split_part(r, '<answer>', 1) WHEN contains(r, '</think>') THEN split_part(r, '</think>', 1) END AS think,
  CASE WHEN regexp_matches(r, '(?s)<answer>.*?</answer>') THEN regexp_extract(r, '(?s)<answer>(.*?)</answer>', 1) WHEN contains(r, '<answer>') THEN split_part(r, '<answer>', 2) WHEN contains(r, '</think>') THEN split_part(r, '</think>', 2) END AS answer,
  regexp_full_match(r, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>')::INT::DOUBLE AS fmt FROM {_RESPONSES}""")
def think_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r")
    th, an = rewards.think_and_answer(r)
    return _responses(spark, sf_dir).select("event_id", th.alias("think"), an.alias("answer"), rewards.format_reward(r).alias("fmt"))


_JUDGED = """(SELECT event_id, 'notes </think> {"score": [' || (event_id % 10) || ', ' || (user_id % 7) || '.5]} Image 1 is better' AS t, '**Alignment Score** (1-5): ' || (user_id % 5) || chr(10) || 'Coherence Score: ' || (event_id % 5) || '.25' AS u FROM events)"""


@query(f"""
SELECT event_id, (regexp_extract(t, '\\[([^,]*),', 1))::DOUBLE AS s1, (regexp_extract(t, ', ([^\\]]*)\\]', 1))::DOUBLE AS s2, 'Edited image 1' AS win, regexp_extract(u, '5\\): (\\d)', 1)::DOUBLE AS alignment,
  regexp_extract(u, 'Coherence Score: ([\\d.]+)', 1)::DOUBLE AS coherence, NULL::DOUBLE AS style, round((regexp_extract(u, '5\\): (\\d)', 1)::DOUBLE + regexp_extract(u, 'Coherence Score: ([\\d.]+)', 1)::DOUBLE) / 2, 6) AS score FROM {_JUDGED}""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    df = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('notes </think> {"score": ['), s(e % 10), F.lit(", "), s(u % 7), F.lit(".5]} Image 1 is better")).alias("t"),
        F.concat(F.lit("**Alignment Score** (1-5): "), s(u % 5), F.lit("\nCoherence Score: "), s(e % 5), F.lit(".25")).alias("u"),
    )
    pair = text.pairwise_scores(F.col("t"))
    return df.select("event_id", F.get(pair, F.lit(0)).alias("s1"), F.get(pair, F.lit(1)).alias("s2"), text.winner(F.col("t")).alias("win"), text.three_scores(F.col("u")).alias("x")).select("event_id", "s1", "s2", "win", "x.alignment", "x.coherence", "x.style", F.round("x.score", 6).alias("score"))


@query(f"""
SELECT event_id, json_extract_string(regexp_extract(t, '(?s)\\{{.*\\}}', 0), '$.score[0]')::INT AS s0 FROM {_JUDGED}""")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    t = F.concat(F.lit('notes </think> {"score": ['), (e % 10).cast("string"), F.lit(", "), (F.col("user_id") % 7).cast("string"), F.lit(".5]} Image 1 is better"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(text.json_object(t), "$.score[0]", "int").alias("s0"))


@query("""SELECT * FROM (VALUES ('Quality', 'Realism', 'Physical Logic'), ('Aesthetics', 'Color Harmony', 'Color Harmony')) AS v(l1, l2, l3)""")
def dims_by_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("Quality / Realism / Physical Logic; Aesthetics / Color Harmony / Color Harmony",)], "d string")
    return df.select(F.inline(text.dimensions(F.col("d"))))


@query("""SELECT event_id, CASE user_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 60.0 WHEN 2 THEN 100.0 END::DOUBLE AS mapped FROM events""")
def map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("user_id") % 5 == 4, "N/A").otherwise((F.col("user_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.map_score(raw).alias("mapped"))


_IMG = "(SELECT id, any_value(file_name) AS file_name, any_value(height) AS height, any_value(width) AS width FROM images WHERE id IS NOT NULL GROUP BY id)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "images").where("id IS NOT NULL").select("id", "file_name", "height", "width").dropDuplicates(["id"])


@query(f"""
SELECT id, lower(list_last(string_split(file_name, '.'))) AS ext, regexp_replace(list_last(string_split(file_name, '/')), '\\.[^.]+$', '') AS stem,
  CASE WHEN lower(list_last(string_split(file_name, '.'))) IN ('jpg', 'jpeg') THEN 'photo' WHEN lower(list_last(string_split(file_name, '.'))) IN ('png') THEN 'drawing' ELSE 'other' END AS route,
  CASE WHEN file_name LIKE '/%' THEN file_name ELSE '/data/' || file_name END AS path FROM {_IMG}""")
def url_ext_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_name")
    route = text.route_by_extension(p, [(("jpg", "jpeg"), F.lit("photo")), (("png",), F.lit("drawing")), (None, F.lit("other"))])
    return _images(spark, sf_dir).select("id", text.extension(p).alias("ext"), text.stem(p).alias("stem"), route.alias("route"), text.absolute_path(p, "/data").alias("path"))


@query(f"""
WITH s AS (SELECT id, height AS h, width AS w, sqrt(height * width / 200000.0) AS k FROM {_IMG} WHERE height IS NOT NULL AND width IS NOT NULL),
t AS (SELECT id, h, w, (floor(CASE WHEN h * w > 200000 THEN floor(h / k) ELSE h END / 16) * 16)::INT AS th, (floor(CASE WHEN h * w > 200000 THEN floor(w / k) ELSE w END / 16) * 16)::INT AS tw FROM s)
SELECT id, th, tw, round_even(h * greatest(tw / w, th / h), 0)::INT AS ch, round_even(w * greatest(tw / w, th / h), 0)::INT AS cw FROM t""")
def resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = F.col("height"), F.col("width")
    th, tw = arrays.target_size(h, w, 200_000, 16)
    df = _images(spark, sf_dir).where(h.isNotNull() & w.isNotNull()).select("id", "height", "width", th.alias("th"), tw.alias("tw"))
    ch, cw = arrays.cover_size(h, w, F.col("th"), F.col("tw"))
    return df.select("id", "th", "tw", ch.alias("ch"), cw.alias("cw"))


@query(f"""
WITH s AS (SELECT id, height AS h, width AS w, height * width AS a FROM {_IMG} WHERE height IS NOT NULL AND width IS NOT NULL),
f AS (SELECT *, CASE WHEN a > 250000 THEN sqrt(250000.0 / a) WHEN a < 100000 THEN sqrt(100000.0 / a) ELSE 1.0 END AS k FROM s)
SELECT id, floor(h * k)::INT AS bh, floor(w * k)::INT AS bw FROM f""")
def bounded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = F.col("height"), F.col("width")
    bh, bw = arrays.bounded_size(h, w, 100_000, 250_000)
    return _images(spark, sf_dir).where(h.isNotNull() & w.isNotNull()).select("id", bh.alias("bh"), bw.alias("bw"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 81 THEN 81 WHEN p_size <= 1 THEN p_size ELSE greatest(1, p_size - (((p_size - 1) % 4) + 4) % 4) END::INT AS n_frames, least(round_even(7 / 16.0 * (p_size % 30 + 5), 0)::INT, p_size - 1)::INT AS frame FROM part""")
def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", arrays.frame_count(n, 81, 4, 1).cast("int").alias("n_frames"), arrays.frame_index(F.lit(7), 16.0, n % 30 + 5, n).cast("int").alias("frame"))


@query("""
SELECT p_partkey, list_distinct(list_transform(range(0, 6), lambda i: floor(i * (p_size - 1) / 5)::INT)).list_sort() AS frames FROM part""")
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(arrays.uniform_frames(F.col("p_size"), F.lit(6))).alias("frames"))


@query("""
SELECT p_partkey, ((p_partkey % 8) + 8 * (p_size % 5) + 40 * (p_partkey % 3))::BIGINT AS code, (p_size % 8)::INT AS l0, ((p_size // 8) % 5)::INT AS l1 FROM part""")
def mixed_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    levels = arrays.radix_levels(s, [8, 5, 3])
    return table(spark, sf_dir, "part").select("p_partkey", arrays.mixed_radix(F.array(k % 8, s % 5, k % 3), [8, 5, 3]).alias("code"), F.get(levels, F.lit(0)).alias("l0"), F.get(levels, F.lit(1)).alias("l1"))


@query(f"""
SELECT conv_id, list_resize(input_ids[1:16], 16, 0) AS right_ids, list_concat(list_transform(range(0, greatest(16 - len(input_ids), 0)), lambda i: 0::BIGINT), input_ids[greatest(len(input_ids) - 15, 1):]) AS left_ids,
  (coalesce(list_position(input_ids, 151655), 0) - 1)::INT AS first_media FROM {_CONV} WHERE input_ids IS NOT NULL""")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, zero = F.col("input_ids"), F.lit(0).cast("bigint")
    df = _conversations(spark, sf_dir).where(ids.isNotNull())
    return df.select("conv_id", arrays.fit(ids, 16, zero, left_pad=False, truncation="right").alias("right_ids"), arrays.fit(ids, 16, zero, left_pad=True, truncation="left").alias("left_ids"), arrays.first_index(ids, F.lit(151655).cast("bigint")).cast("int").alias("first_media"))



@query(f"""
SELECT conv_id, list_transform(input_ids, lambda x, i: (coalesce(list_position(input_ids, 151655), 0) = 0 OR i <= list_position(input_ids, 151655))::INT) AS mask FROM {_CONV} WHERE input_ids IS NOT NULL""")
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).where(F.col("input_ids").isNotNull()).select("conv_id", arrays.response_mask(F.col("input_ids"), [151655]).alias("mask"))


_ALL_BITS = """(SELECT conv_id, list_transform(input_ids, lambda x: (x % 3 = 0)::INT) AS b FROM """ + _CONV + """ WHERE len(input_ids) > 0)"""


def _all_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 array over the whole sequence of every conversation."""
    return _conversations(spark, sf_dir).where(F.size("input_ids") > 0).select("conv_id", F.transform("input_ids", lambda x: (x % 3 == 0).cast("int")).alias("b"))


@query(f"""
WITH f AS (SELECT conv_id, unnest(list_prepend(0, b)) AS v, generate_subscripts(list_prepend(0, b), 1) AS i FROM {_ALL_BITS}),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, v ORDER BY i) AS grp FROM f), r AS (SELECT conv_id, v, grp, min(i) AS first, count(*) - (min(i) = 1)::INT AS n FROM g GROUP BY ALL)
SELECT conv_id, list(n::INT ORDER BY first) AS runs FROM r GROUP BY conv_id""")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_bits(spark, sf_dir).select("conv_id", arrays.run_lengths(F.col("b")).alias("runs"))


@query(f"""
WITH b AS (SELECT conv_id, b, list_transform(b, lambda x, i: (i % 2 = 0)::INT) AS c FROM {_ALL_BITS}),
n AS (SELECT conv_id, list_sum(list_transform(list_zip(b, c), lambda z: z[1] * z[2])) AS i, list_sum(list_transform(list_zip(b, c), lambda z: greatest(z[1], z[2]))) AS u FROM b)
SELECT conv_id, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM n""")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _all_bits(spark, sf_dir).select("conv_id", arrays.from_run_lengths(arrays.run_lengths(F.col("b"))).alias("a"))
    return df.select("conv_id", F.round(arrays.mask_iou(F.col("a"), F.transform("a", lambda _, i: (i % 2 == 1).cast("int"))), 6).alias("iou"))


@query("""
WITH a AS (SELECT id, any_value(bbox) AS b FROM annotations WHERE id IS NOT NULL GROUP BY id), n AS (SELECT id, b, greatest(least(b[1] + b[3], 400.0) - greatest(b[1], 100.0), 0) * greatest(least(b[2] + b[4], 400.0) - greatest(b[2], 100.0), 0) AS i FROM a WHERE len(b) = 4)
SELECT id, round(CASE WHEN b[3] * b[4] + 90000.0 - i > 0 THEN i / (b[3] * b[4] + 90000.0 - i) ELSE 0 END, 6) AS iou FROM n""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "annotations").where("id IS NOT NULL").select("id", "bbox").dropDuplicates(["id"]).where(F.size("bbox") == 4)
    a = tuple(F.get("bbox", F.lit(i)) for i in range(4))
    b = (F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(300.0))
    return df.select("id", F.round(arrays.box_iou(a, b), 6).alias("iou"))


@query(f"""
SELECT id, list_transform(regexp_extract_all(file_name, '(\\d+|\\D+)'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(len(regexp_replace(r, '^0+(.)', '\\1'))::VARCHAR, 4, '0') || regexp_replace(r, '^0+(.)', '\\1') ELSE r END).array_to_string('') AS k FROM {_IMG} WHERE file_name IS NOT NULL""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).where(F.col("file_name").isNotNull()).select("id", text.natural_key(F.col("file_name")).alias("k"))


@query("""SELECT md5(array_to_string(list_sort(list(k)), ',')) AS fingerprint FROM (SELECT n_name AS k FROM nation UNION ALL SELECT n_name || ':' || n_nationkey || '_' || n_regionkey FROM nation)""")
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_name", F.array("n_nationkey", "n_regionkey").alias("shape"))
    return text.schema_fingerprint(df, "n_name", "shape")


@query("""
SELECT doc_id, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk, CASE WHEN regexp_matches(source, '^https?://') THEN true ELSE false END AS url FROM documents WHERE text IS NOT NULL""")
def has_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.has_cjk(F.col("text")).alias("cjk"), text.is_url(F.col("source")).alias("url"))


@query("""
SELECT p_partkey, '<|mt_start|><|mt_' || lpad((p_partkey % 256)::VARCHAR, 4, '0') || '|><|mt_' || lpad((256 + p_size)::VARCHAR, 4, '0') || '|><|mt_end|>' AS tok FROM part""")
def mask_token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rewards.mask_token_text(F.array((F.col("p_partkey") % 256).cast("int"), F.col("p_size"))).alias("tok"))
