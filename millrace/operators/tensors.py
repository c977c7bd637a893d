"""Tables of named tensors: one row per file and name with shape and values; lookups, exports, renames and merges.

``file`` is the place of a file in its list (later files win), ``name`` the tensor's
name, ``shape`` its sizes, ``data`` its values in row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregates import keep_last


def load_files(tensors: DataFrame) -> DataFrame:
    """Of every name the tensor of the last file that has it."""
    return keep_last(tensors, ["name"], ["file"])


def unwrap_single(tensors: DataFrame, *wrappers: str) -> DataFrame:
    """Names without a common wrapper: a file whose names all stand under one of the wrappers loses it."""
    head = F.substring_index("name", ".", 1)
    per = tensors.groupBy("file").agg(F.min(head).alias("_lo"), F.max(head).alias("_hi"))
    single = per.select("file", F.when((F.col("_lo") == F.col("_hi")) & F.col("_lo").isin(*wrappers), F.col("_lo")).alias("_w"))
    short = F.when(F.col("_w").isNotNull(), F.expr("substring(name, length(_w) + 2)")).otherwise(F.col("name"))
    return tensors.join(single, "file").withColumn("name", short).drop("_w")


def find(tensors: DataFrame, names: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Tensors by a table of names, renamed ones under their old name; an unknown name is an error."""
    asked = names.select(F.col("name").alias("asked"))
    pick = F.create_map(*[F.lit(x) for kv in (renamed or {}).items() for x in kv]) if renamed else None
    key = F.coalesce(F.try_element_at(pick, F.col("asked")), F.col("asked")) if pick is not None else F.col("asked")
    out = asked.withColumn("name", key).join(load_files(tensors), "name", "left")
    known = F.assert_true(F.col("shape").isNotNull(), F.concat(F.lit("no tensor "), "name"))
    return out.where(known.isNull()).drop("name").withColumnRenamed("asked", "name")


def trainable(tensors: DataFrame, names: DataFrame, prefix: str | None = None) -> DataFrame:
    """The tensors of the listed names, without a leading prefix."""
    out = tensors.join(names.select("name").distinct(), "name", "left_semi")
    return out.withColumn("name", F.when(F.col("name").startswith(prefix), F.substring("name", len(prefix) + 1, 1 << 30)).otherwise(F.col("name"))) if prefix else out


def low_rank_names(tensors: DataFrame) -> DataFrame:
    """Low-rank factors only, their names with the adapter's name in them."""
    out = tensors.where(F.col("name").rlike(r"lora_[AB]\.(default\.)?weight"))
    return out.withColumn("name", F.regexp_replace("name", r"(lora_[AB])\.weight", "$1.default.weight"))


def _joined(side: Column, order: Column, value: Column) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct(order.alias("o"), value.alias("v"))))), lambda s: s["v"]))


def merge_low_rank(tensors: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``name, shape, data``: the factors of several files as one: A stacked by rows (times ``alpha``), B by columns.

    Names that the first file has count.  A factor's rows are joined per row of the
    result, so one task holds one row of one tensor.
    """
    first = tensors.agg(F.min("file").alias("_f"))
    named = tensors.join(F.broadcast(first), F.lit(True)).where(F.col("file") == F.col("_f")).select("name").distinct()
    kept = tensors.join(named, "name", "left_semi").where(F.col("name").contains(".lora_A.") | F.col("name").contains(".lora_B."))
    is_a, width = F.col("name").contains(".lora_A."), F.col("shape")[1]
    rows = kept.select(
        "name", "file", is_a.alias("is_a"), width.alias("w"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("shape")[0] - 1), lambda r: F.slice("data", (r * width + 1).cast("int"), width.cast("int")))).alias("r", "row"),
    )
    whole = rows.groupBy("name", "is_a", F.when(F.col("is_a"), F.col("file")).alias("f"), "r").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", "row"))), lambda s: s["row"])).alias("row")
    )
    scaled = F.when(F.col("is_a"), F.transform("row", lambda x: x * F.lit(alpha))).otherwise(F.col("row"))
    put = whole.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("f", "r", scaled.alias("row")))).alias("s"))
    return put.select("name", F.array(F.size("s"), F.size(F.get("s", F.lit(0))["row"])).alias("shape"), F.flatten(F.transform("s", lambda s: s["row"])).alias("data"))


def merge_caches(caches: DataFrame) -> DataFrame:
    """``param, key, value`` of several templates (``template`` is their order): cached arrays and embeddings are joined per key, of other params the first stays."""
    joins = F.col("param").isin("kv_cache", "text_embedding")
    rows = F.array_sort(F.collect_list(F.struct("template", "value")))
    per = caches.groupBy("param", "key").agg(rows.alias("s"))
    return per.select("param", "key", F.when(joins, F.flatten(F.transform("s", lambda x: x["value"]))).otherwise(F.get("s", F.lit(0))["value"]).alias("value"))
