"""Text, JSON and conversation expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of numbers, scores and verdicts in judge answers.
NUMBER = r"[-+]?\d*\.?\d+"
SCORE_LIST = r'(?i)"?score"?\s*:\s*\[([^\]]+)\]'
NAMED_PAIR = rf"(?is)image\s*1[^-+\d]*({NUMBER}).*?image\s*2[^-+\d]*({NUMBER})"
EDITED_PAIR = r"(?is)Edited\s*Image\s*1[^-+\d]*([-+]?\d*\.?\d+).*?Edited\s*Image\s*2[^-+\d]*([-+]?\d*\.?\d+)"
PLAIN_PAIR = r"(?is)score(?:s)?[^-+\d]*([-+]?\d*\.?\d+)[^\n\r-+\d]+([-+]?\d*\.?\d+)"
TIE = r"(?i)both images? (are )?(equally good|equal|tie)"
FIRST_WINS = r"(?is)((edited )?image\s*1|first image).{0,24}\b(better|best|wins?|preferred|superior)\b"
SECOND_WINS = r"(?is)((edited )?image\s*2|second image).{0,24}\b(better|best|wins?|preferred|superior)\b"
MESSAGES = "array<struct<from:string,value:string>>"


_SENTINEL = "json-value-ends-here-7f3a91c5"


def parse_json(text: Column) -> Column:
    """One JSON value as a variant; null where the text is damaged or goes on after the value.

    Spark's parser ignores what follows a first value.  Here the text stands
    before a sentinel in a list, so only a text of exactly one value reaches it.
    """
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')))
    alone = ~text.contains(_SENTINEL) & (F.try_variant_get(held, "$[1]", "string") == _SENTINEL)
    return F.when(alone, F.try_variant_get(held, "$[0]", "variant"))


def word_count(text: Column) -> Column:
    """Blank-separated words; none in null or blank text."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(text.isNull() | (t == ""), 0).otherwise(F.size(F.split(t, " ")))


def conversation_words(turns: Column, image: Column | None = None, image_tokens: int = 128) -> Column:
    """Words over all turns, plus a fixed number for an image."""
    words = F.aggregate(F.coalesce(turns, F.array().cast(MESSAGES)), F.lit(0), lambda a, t: a + word_count(t["value"]))
    return words if image is None else words + F.when(image.isNotNull(), image_tokens).otherwise(0)


def signed_length(words: Column, image: Column) -> Column:
    """Length by modality: negative for rows without media."""
    return F.when(image.isNotNull(), words).otherwise(-words)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _message(v: Column, text: Column) -> Column:
    """An object as it is, anything else as said by a human."""
    said = F.struct(F.lit("human").alias("from"), text.alias("value"))
    return F.when(_kind(v).startswith("OBJECT<"), F.try_variant_get(v, "$", "struct<from:string,value:string>")).otherwise(said)


def normalise_messages(raw: Column) -> Column:
    """JSON list, JSON object, JSON string or plain text -> list of messages; what is no message is said by a human.

    A list gives one message per element; text elements that hold a JSON object are
    read.  Text that only begins with a JSON value stays whole.  Null has no message.
    """
    v = parse_json(raw)
    kind = _kind(v)
    text = F.coalesce(F.try_variant_get(v, "$", "string"), raw)
    element = lambda x: F.when(_kind(x) == "STRING", _message(parse_json(F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$", "string"))).otherwise(_message(x, F.try_variant_get(x, "$", "string")))
    return (
        F.when(raw.isNull(), F.array().cast(MESSAGES))
        .when(v.isNull(), F.array(F.struct(F.lit("human").alias("from"), raw.alias("value"))))
        .when(kind.startswith("ARRAY<"), F.transform(F.try_variant_get(v, "$", "array<variant>"), element))
        .otherwise(F.array(_message(v, text)))
        .cast(MESSAGES)
    )


def chat_role(role: Column) -> Column:
    r = F.lower(F.trim(role))
    return F.when(r.isin("human", "user"), "user").when(r.isin("gpt", "assistant"), "assistant").otherwise(r)


def drop_leading_answer(turns: Column) -> Column:
    """A conversation that does not open with a question loses its first turn."""
    first = F.lower(F.get(turns, F.lit(0))["from"])
    return F.when(first.isin("human", "user"), turns).otherwise(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))))


def interleave(prompt: Column, media: Column, mark: str = "<image>") -> Column:
    """Text and media parts in order; the number of placeholders must match the media."""
    texts = F.split(prompt, f"\\Q{mark}\\E")
    ok = F.size(texts) - 1 == F.size(media)
    part = lambda t, m: F.struct(F.lit(None if t is None else "text").alias("type") if m is None else F.lit("image").alias("type"), (m if m is not None else t).alias("value"))
    parts = F.flatten(
        F.transform(
            texts,
            lambda t, i: F.when(i == 0, F.array(part(t, None))).otherwise(F.array(part(None, F.get(media, i - 1)), part(F.regexp_replace(t, r"^\n", ""), None))),
        )
    )
    return F.when(ok, F.filter(parts, lambda p: (p["type"] == "image") | (p["value"] != ""))).otherwise(F.raise_error(F.lit("placeholders and media differ")))


def json_answer(text: Column) -> Column:
    """The JSON value of a model answer: what follows the last thought, whole, else from the first to the last brace; else null."""
    tail = F.trim(F.substring_index(text, "</think>", -1), F.lit(" \t\r\n\f\x0b"))
    return F.coalesce(parse_json(tail), parse_json(F.regexp_extract(tail, r"(?s)\{.*\}", 0)))


def json_object(text: Column) -> Column:
    """As ``json_answer``, objects only."""
    v = json_answer(text)
    return F.when(_kind(v).startswith("OBJECT<"), v)


def braced_json(text: Column) -> Column:
    """The text from the first to the last brace as JSON, with single quotes read as double ones where it is none; else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(parse_json(body), parse_json(F.replace(body, F.lit("'"), F.lit('"'))))


def fenced_json(text: Column) -> Column:
    """A fenced or bare JSON object; lists and anything else are null."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return json_object(F.when(inner != "", inner).otherwise(text))


def pointwise_scores(text: Column) -> Column:
    """``struct<editing_success, overediting, score, reasoning>`` of a judge answer: the list under ``score``, else the first list after the word."""
    v = braced_json(text)
    listed = F.transform(F.try_variant_get(v, "$.score", "array<variant>"), coerce_float)
    given = F.filter(F.coalesce(listed, F.array().cast("array<double>")), lambda x: x.isNotNull())
    both = F.when(F.size(given) > 0, given).otherwise(score_list(text))
    a, b = F.get(both, F.lit(0)), F.get(both, F.lit(1))
    return F.struct(a.alias("editing_success"), b.alias("overediting"), mean_of(a, b).alias("score"), F.try_variant_get(v, "$.reasoning", "string").alias("reasoning"))


def dimension_scores(text: Column) -> Column:
    """``array<struct<l2, l3, raw>>`` of a judge answer about one first-level dimension: a score under each third level, nested or flat (then without l2).

    ``raw`` is the score as text; a value that is no object is the score itself.  Null where the answer is no JSON object.
    """
    flat = F.try_variant_get(json_object(text), "$", "map<string,variant>")
    raw = lambda v: F.coalesce(F.try_variant_get(v, "$.score", "string"), F.when(~_kind(v).startswith("OBJECT<"), F.try_variant_get(v, "$", "string")))
    scored = lambda v: F.try_variant_get(v, "$.score", "string").isNotNull()
    entry = lambda l2, l3, v: F.struct(l2.cast("string").alias("l2"), l3.alias("l3"), raw(v).alias("raw"))

    def of(e: Column) -> Column:
        inner = F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))
        nested = F.transform(F.coalesce(inner, F.array().cast("array<struct<key:string,value:variant>>")), lambda x: entry(e["key"], x["key"], x["value"]))
        return F.when(scored(e["value"]), F.array(entry(F.lit(None), e["key"], e["value"]))).otherwise(nested)

    return F.flatten(F.transform(F.map_entries(flat), of))


#: The tasks of the edit judge.
JUDGE_TASKS = ("edit_pointwise_score", "edit_pairwise_score", "edit_pairwise_rank")


def judge_output(text: Column, task: Column) -> Column:
    """``struct<editing_success, overediting, score, reasoning, image_1_score, image_2_score, winner>`` by task; another task is an error."""
    point, pair = pointwise_scores(text), pairwise_scores(text)
    none = lambda t: F.lit(None).cast(t)
    kind = "struct<editing_success:double,overediting:double,score:double,reasoning:string,image_1_score:double,image_2_score:double,winner:string>"
    at = lambda *c: F.struct(*c).cast(kind)
    return (
        F.when(task == JUDGE_TASKS[0], at(point["editing_success"], point["overediting"], point["score"], point["reasoning"], none("double"), none("double"), none("string")))
        .when(task == JUDGE_TASKS[1], at(none("double"), none("double"), none("double"), none("string"), F.get(pair, F.lit(0)), F.get(pair, F.lit(1)), none("string")))
        .when(task == JUDGE_TASKS[2], at(none("double"), none("double"), none("double"), none("string"), none("double"), none("double"), winner(text)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown task "), F.coalesce(task, F.lit("null")))).cast(kind))
    )


def winner_number(verdict: Column) -> Column:
    """A verdict as 0 (tie or none), 1 or 2."""
    w = F.lower(verdict)
    one, two = w.contains("image 1"), w.contains("image 2")
    tie = w.contains("equally") | w.contains("tie") | (one & two)
    return F.coalesce(F.when(tie, 0).when(one | w.contains("first image"), 1).when(two | w.contains("second image"), 2), F.lit(0))


def primary_score(parsed: Column, task: Column) -> Column:
    """The main scores of a parsed judge answer, as an array: one score, two scores of a pair, or the winner's number."""
    return (
        F.when(task == JUDGE_TASKS[2], F.array(winner_number(parsed["winner"]).cast("double")))
        .when(task == JUDGE_TASKS[1], F.array(parsed["image_1_score"], parsed["image_2_score"]))
        .otherwise(F.array(parsed["score"]))
    )


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")


def coerce_float(v: Column) -> Column:
    """A variant as a number: numbers as they are, text by its first number, booleans and the rest null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double")).when(kind == "STRING", first_number(F.try_variant_get(v, "$", "string")))


def score_list(text: Column) -> Column:
    """The numbers of ``score: [...]``."""
    body = F.regexp_extract(text, SCORE_LIST, 1)
    return F.transform(F.regexp_extract_all(body, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.try_cast("double"))


def pair_scores(text: Column) -> Column:
    """Two numbers said of image 1 and image 2, else two numbers after the word score, as the fixed patterns have them."""
    both = lambda p: F.array(F.regexp_extract(text, p, 1).try_cast("double"), F.regexp_extract(text, p, 2).try_cast("double"))
    found = F.when(text.rlike(NAMED_PAIR), both(NAMED_PAIR)).when(text.rlike(EDITED_PAIR), both(EDITED_PAIR)).when(text.rlike(PLAIN_PAIR), both(PLAIN_PAIR))
    return found.otherwise(F.array().cast("array<double>"))


def pairwise_scores(text: Column) -> Column:
    listed = score_list(text)
    return F.when(F.size(listed) >= 2, F.slice(listed, 1, 2)).otherwise(pair_scores(text))


def winner(text: Column) -> Column:
    """The label of a comparison (a tie is looked for first), else null."""
    return (
        F.when(text.rlike(TIE), "Edited image 1 and 2 are equally good")
        .when(text.rlike(FIRST_WINS), "Edited image 1").when(text.rlike(SECOND_WINS), "Edited image 2")
    )


def labelled_number(text: Column, label: str) -> Column:
    """The number after a label, with an optional remark in parentheses; asterisks do not count."""
    return F.regexp_extract(F.replace(text, F.lit("*"), F.lit("")), rf"(?i)\Q{label}\E\s*(?:\([^)]+\))?\s*[:：]\s*({NUMBER})", 1).try_cast("double")


def mean_of(*values: Column) -> Column:
    """Mean of the values that are not null; null where none is."""
    kept = F.array_compact(F.array(*values))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def three_scores(text: Column) -> Column:
    parts = [labelled_number(text, f"{n} Score") for n in ("Alignment", "Coherence", "Style")]
    return F.struct(parts[0].alias("alignment"), parts[1].alias("coherence"), parts[2].alias("style"), mean_of(*parts).alias("score"))


def map_score(raw: Column) -> Column:
    """Grades 0, 1, 2 as 0, 60, 100; anything else null."""
    n = raw.try_cast("int")
    return F.when(n == 0, 0.0).when(n == 1, 60.0).when(n == 2, 100.0)


def dimensions(text: Column) -> Column:
    """``a / b / c; ...`` as rows of (level1, level2, level3): two levels repeat the second, more than three keep the first three, one is no row."""
    rows = F.filter(F.transform(F.split(text, ";"), lambda r: F.transform(F.split(r, "/"), lambda p: F.trim(p, F.lit(" \t\r\n")))), lambda p: F.size(p) >= 2)
    return F.transform(rows, lambda p: F.struct(p[0].alias("l1"), p[1].alias("l2"), F.coalesce(F.get(p, F.lit(2)), p[1]).alias("l3")))


#: The first-level dimensions of the bench.
LEVEL1 = ("Quality", "Aesthetics", "Alignment", "Real-world Fidelity", "Creative Generation")


def asked_dimensions(asked: Column) -> Column:
    """First-level dimensions of a request: rows of levels, a comma list or one name; all where nothing is asked, an unknown one is an error."""
    parts = (
        F.when(asked.rlike("[/;]"), F.array_distinct(F.transform(dimensions(asked), lambda d: d["l1"])))
        .when(asked.contains(","), F.filter(F.transform(F.split(asked, ","), lambda x: F.trim(x)), lambda x: x != ""))
        .otherwise(F.array(asked))
    )
    every = F.array(*[F.lit(x) for x in LEVEL1])
    dims = F.when(asked.isNull() | (F.size(parts) == 0), every).otherwise(parts)
    wrong = F.filter(dims, lambda d: ~d.isin(*LEVEL1))
    return F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("unsupported dimension "), F.get(wrong, F.lit(0)))).cast("array<string>")).otherwise(dims)


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\x{4e00}-\\x{9fff}]")


def is_url(path: Column) -> Column:
    return F.coalesce(path.rlike("^https?://"), F.lit(False))


def absolute_path(path: Column, base: str) -> Column:
    """A URL or absolute path as it is, else below the base."""
    joined = path if not base else F.concat(F.lit(base.rstrip("/") + "/"), path)
    return F.when(is_url(path) | path.startswith("/"), path).otherwise(joined)


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def route_by_extension(path: Column, routes: list[tuple[tuple[str, ...] | None, Column]]) -> Column:
    """The value of the first matching extension group; None is the default; without one an error."""
    out, ext = None, extension(path)
    for group, value in routes:
        test = F.lit(True) if group is None else ext.isin(*group)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if routes and routes[-1][0] is None else out.otherwise(F.raise_error(F.concat(F.lit("no route for "), path)))


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs compare as numbers: every run is written with its length before it."""
    runs = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda r: F.when(
        r.rlike(r"^\d"), F.concat(F.lpad(F.length(F.regexp_replace(r, "^0+(?=.)", "")).cast("string"), 4, "0"), F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(r))
    return F.array_join(runs, "")


def schema_key(df: DataFrame, name: str, shape: str, group: str | None = None, with_shape: bool = True) -> DataFrame:
    """``[group,] key``: the sorted names and ``name:shape`` entries of a file's tensors as one text.

    The result is one text per file by definition; with ``group`` (a file's name) every
    file is put together in its own task.
    """
    entry = F.concat(F.col(name), F.lit(":"), F.array_join(F.col(shape).cast("array<string>"), "_"))
    entries = df.select(*([group] if group else []), F.explode(F.array(F.col(name), entry) if with_shape else F.array(name)).alias("_e"))
    text = F.array_join(F.array_sort(F.collect_list("_e")), ",").alias("key")
    return entries.groupBy(group).agg(text) if group else entries.agg(text)


def schema_fingerprint(df: DataFrame, name: str, shape: str, group: str | None = None, with_shape: bool = True) -> DataFrame:
    """``[group,] fingerprint``: MD5 of ``schema_key``."""
    key = schema_key(df, name, shape, group, with_shape)
    return key.select(*([group] if group else []), F.md5("key").alias("fingerprint"))


def sampling_rate(name: Column) -> Column:
    """``name%NN`` as a rate; 1 without the suffix."""
    pct = F.regexp_extract(name, r"%(\d+)$", 1)
    return F.when(pct != "", pct.cast("double") / 100).otherwise(1.0)
