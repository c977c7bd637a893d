"""Deeply nested, loosely typed records to flat tables with parent links.

The nesting is taken apart by higher-order SQL functions inside the row: nested
``transform`` calls attach keys and indices, ``flatten`` joins the levels, and a
single ``inline`` per target table emits the rows.  No explode/regroup and no
Python is involved, so one annotation with many masks costs one row's work.

Defined results
---------------
* null, blank and empty values have no child; ``{}``, ``[]``, ``[[]]`` neither;
* text that is not one JSON value (or has more behind it) gives one child ``unreadable`` at 0;
* JSON strings holding JSON are read through and lists in lists are opened, however deep they are;
* repeated keys count once (the newest row, ties by content), null keys are dropped;
* extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import parse_json

STEPS = 2  # levels opened by plain projections; deeper rows go on in a loop of their own
_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\))"
_BLANKS = " \t\r\n"
_ITEM = "struct<v:variant,t:string>"


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _typed(v: Column) -> Column:
    return F.struct(v.alias("v"), _type(v).alias("t"))


def _flat(t: Column) -> Column:
    return t.rlike(rf"^ARRAY<{_NUMBER}>$")


def _point_ring(x: Column) -> Column:
    return x["t"].rlike(rf"^ARRAY<ARRAY<{_NUMBER}>>$") & F.forall(F.try_variant_get(x["v"], "$", "array<array<double>>"), lambda p: F.size(p) == 2)


def _leaf(x: Column) -> Column:
    return x["t"].startswith("OBJECT<") | _flat(x["t"]) | _point_ring(x)


def _elements(x: Column) -> Column:
    """The elements of a list with their types; of a leaf, itself; of a JSON string, what it holds."""
    held = parse_json(F.try_variant_get(x["v"], "$", "string"))
    return (
        F.when(_leaf(x), F.array(x))
        .when(x["t"].startswith("ARRAY<"), F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), _typed))
        .when(x["t"] == "STRING", F.array(_typed(held)))
        .otherwise(F.array())
        .cast(f"array<{_ITEM}>")
    )


def _open(items: Column) -> Column:
    return F.flatten(F.transform(items, _elements)).cast(f"array<{_ITEM}>")


def _closed(items: Column) -> Column:
    return ~F.exists(items, lambda x: ~_leaf(x))


def _to_the_end(items: Column, text: Column) -> Column:
    """Opened until only leaves are left; every level takes a character of the text, so its length bounds the loop."""
    step = lambda acc, _: F.when(acc["done"], acc).otherwise(F.struct(_open(acc["items"]).alias("items"), _closed(_open(acc["items"])).alias("done")))
    state = f"struct<items:array<{_ITEM}>,done:boolean>"
    start = F.struct(items.alias("items"), F.lit(False).alias("done")).cast(state)
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, lambda acc, n: step(acc, n).cast(state), lambda acc: acc["items"])


def _unwrap(v: Column) -> Column:
    return F.when(_type(v) == "STRING", parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def parsed(annotations: DataFrame) -> DataFrame:
    """``id, ingested_at, counts, damaged, size, items``: the leaves of ``segmentation`` with their types.

    Each step is a projection of its own, so every text is parsed and every
    value's type is told once, not once per use.  Rows deeper than ``STEPS``
    levels take the loop, which no other row enters.
    """
    df = annotations.select("id", "ingested_at", "segmentation", "counts", parse_json(F.col("segmentation")).alias("root"))
    for _ in range(STEPS):
        df = df.withColumn("t", _type(F.col("root")))
        held = parse_json(F.try_variant_get("root", "$", "string"))
        df = df.withColumn("root", F.when(F.col("t") == "STRING", held).otherwise(F.col("root")))
    # every encoding doubles the escapes before the innermost quote: a text of less than 2^31 characters has at most 32
    encoded = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.col("root"), lambda v, _: _unwrap(v))
    df = df.withColumn("root", F.when(_type(F.col("root")) == "STRING", encoded).otherwise(F.col("root")))
    df = df.withColumn("x", _typed(F.col("root")))
    blank = F.col("segmentation").isNull() | (F.trim("segmentation", F.lit(_BLANKS)) == "")
    df = df.select(
        "id", "ingested_at", "counts", "segmentation", (~blank & F.col("root").isNull()).alias("damaged"),
        F.when(F.col("x.t").startswith("OBJECT<"), F.try_variant_get("root", "$.size", "array<int>")).alias("size"), _elements(F.col("x")).alias("items"),
    )
    for _ in range(STEPS):
        df = df.withColumn("items", F.when(_closed(F.col("items")), F.col("items")).otherwise(_open(F.col("items"))))
    return df.withColumn("items", F.when(_closed(F.col("items")), F.col("items")).otherwise(_to_the_end(F.col("items"), F.col("segmentation")))).drop("segmentation")


_RUNS = r"^\s*\[[-+0-9.eE,\s]*[0-9][-+0-9.eE,\s]*\]\s*$"


def _mask_kind(inside: Column, t: Column) -> Column:
    """The kind of a mask by its ``counts`` (a variant and its type), null where they hold nothing."""
    text = F.try_variant_get(inside, "$", "string")
    return F.when(_flat(t), "run_lengths").when(t == "STRING", _text_kind(text))


def _text_kind(text: Column) -> Column:
    """The kind of counts given as text: a JSON list of runs or a coded string."""
    body = F.trim(text, F.lit(_BLANKS))
    return F.when(body.rlike(_RUNS), "run_lengths").when((body != "") & ~body.isin("[]", "null", '""'), "coded_mask")


def _inside(x: Column) -> Column:
    return F.try_variant_get(x["v"], "$.counts", "variant")


def _kind(x: Column) -> Column:
    """Of a leaf: its kind, or 'outside' for a mask whose counts stand elsewhere, or null."""
    inside = _inside(x)
    return F.when(~x["t"].startswith("OBJECT<"), "polygon").otherwise(
        F.when(inside.isNull() | (_type(inside) == "VOID"), "outside").otherwise(_mask_kind(inside, _type(inside)))
    )


def _with_kinds(annotations: DataFrame) -> DataFrame:
    """``parsed`` with ``kids``: ``array<struct<kind, x>>`` in stored order; ``x`` is null where the counts stand outside."""
    df = parsed(annotations).withColumn("outer", _text_kind(F.col("counts")))
    df = df.withColumn("kids", F.filter(F.transform("items", lambda x: F.struct(F.when(_leaf(x), _kind(x)).alias("kind"), x.alias("x"))), lambda k: k["kind"].isNotNull()))
    kept = F.filter(
        F.transform("kids", lambda k: F.struct(F.when(k["kind"] == "outside", F.col("outer")).otherwise(k["kind"]).alias("kind"), (k["kind"] == "outside").alias("away"), k["x"].alias("x"))),
        lambda k: k["kind"].isNotNull(),
    )
    df = df.withColumn("kids", kept)
    none = F.lit(None).cast("struct<v:variant,t:string>")
    alone = F.array(F.struct(F.col("outer").alias("kind"), F.lit(True).alias("away"), none.alias("x")))
    return df.withColumn(
        "kids",
        F.when(F.col("damaged"), F.array(F.struct(F.lit("unreadable").alias("kind"), F.lit(False).alias("away"), none.alias("x"))))
        .when((F.size("kids") == 0) & F.col("outer").isNotNull(), alone)
        .otherwise(F.col("kids")),
    )


def _newest(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row per non-null key: the newest, ties by content."""
    row = F.struct(F.col("ingested_at"), *values)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_r")).select(key, *[F.col(f"_r.{v}").alias(v) for v in values])


def annotation_children(annotations: DataFrame) -> DataFrame:
    """``id, children``: ``array<struct<kind,coords,runs,coded,size>>`` of every annotation.

    The text is taken apart before repeats are removed: the shuffle carries the
    typed arrays, never the raw JSON.
    """

    def full(k: Column) -> Column:
        x, inside = k["x"], _inside(k["x"])
        text = F.when(k["away"], F.col("counts")).when(_type(inside) == "STRING", F.try_variant_get(inside, "$", "string"))
        ring = F.when(_flat(x["t"]), F.try_variant_get(x["v"], "$", "array<double>")).otherwise(F.flatten(F.try_variant_get(x["v"], "$", "array<array<double>>")))
        runs = F.when(text.isNotNull(), F.from_json(text, "array<bigint>")).otherwise(F.try_variant_get(inside, "$", "array<bigint>"))
        return F.struct(
            k["kind"].alias("kind"),
            F.when(k["kind"] == "polygon", ring).alias("coords"),
            F.when(k["kind"] == "run_lengths", runs).alias("runs"),
            F.when(k["kind"] == "coded_mask", text).alias("coded"),
            F.when(k["kind"].isin("run_lengths", "coded_mask"), F.coalesce(F.try_variant_get(x["v"], "$.size", "array<int>"), F.col("size"))).alias("size"),
        )

    return _newest(_with_kinds(annotations).select("id", "ingested_at", F.transform("kids", full).alias("children")), "id", "children")


def mask_kinds(annotations: DataFrame) -> DataFrame:
    """``id, kinds``: only the kind of every child travels through the shuffle."""
    return _newest(_with_kinds(annotations).select("id", "ingested_at", F.col("kids.kind").alias("kinds")), "id", "kinds")


def polygons(annotations: DataFrame) -> DataFrame:
    kids = annotation_children(annotations)
    rows = F.filter(
        F.transform(F.col("children"), lambda c, i: F.struct(F.col("id").alias("parent_id"), i.cast("int").alias("child_pos"), c["kind"].alias("kind"), c["coords"].alias("coords"))),
        lambda r: r["kind"] == "polygon",
    )
    return kids.select(F.inline(rows)).drop("kind").withColumn("n_points", (F.size("coords") / 2).cast("int"))


def masks(annotations: DataFrame) -> DataFrame:
    kids = annotation_children(annotations)
    rows = F.filter(
        F.transform(
            F.col("children"),
            lambda c, i: F.struct(
                F.col("id").alias("parent_id"), i.cast("int").alias("child_pos"), c["kind"].alias("kind"),
                F.get(c["size"], F.lit(0)).alias("height"), F.get(c["size"], F.lit(1)).alias("width"),
                c["runs"].alias("runs"), c["coded"].alias("coded"),
            ),
        ),
        lambda r: r["kind"].isin("run_lengths", "coded_mask"),
    )
    return kids.select(F.inline(rows))


def sentences(refs: DataFrame) -> DataFrame:
    """``ref_id, child_pos, sent_id, sent, n_tokens``."""
    rows = F.transform(
        F.coalesce(F.col("sentences"), F.array().cast(refs.schema["sentences"].dataType)),
        lambda s, i: F.struct(
            F.col("ref_id").alias("ref_id"), i.cast("int").alias("child_pos"), s["sent_id"].alias("sent_id"), s["sent"].alias("sent"),
            F.when(s["tokens"].isNull(), F.lit(0)).otherwise(F.size(s["tokens"])).cast("int").alias("n_tokens"),
        ),
    )
    return _newest(refs, "ref_id", "sentences").select(F.inline(rows))


def tokens(refs: DataFrame) -> DataFrame:
    """``ref_id, sent_pos, sent_id, tok_pos, token``: two nested transforms, one flatten, one inline."""
    rows = F.flatten(
        F.transform(
            F.coalesce(F.col("sentences"), F.array().cast(refs.schema["sentences"].dataType)),
            lambda s, i: F.transform(
                F.coalesce(s["tokens"], F.array().cast("array<string>")),
                lambda t, j: F.struct(
                    F.col("ref_id").alias("ref_id"), i.cast("int").alias("sent_pos"), s["sent_id"].alias("sent_id"),
                    j.cast("int").alias("tok_pos"), t.alias("token"),
                ),
            ),
        )
    )
    return _newest(refs, "ref_id", "sentences").select(F.inline(rows))


def children(annotations: DataFrame, refs: DataFrame) -> DataFrame:
    """Every child of both parents: ``parent_table, parent_id, child_kind, child_pos``."""

    def emit(df: DataFrame, parent: str, key: str, kinds: Column) -> DataFrame:
        rows = F.transform(
            kinds,
            lambda k, i: F.struct(
                F.lit(parent).alias("parent_table"), F.col(key).alias("parent_id"), k.alias("child_kind"), i.cast("int").alias("child_pos")
            ),
        )
        return df.select(F.inline(rows))

    refs_kinds = refs.select("ref_id", "ingested_at", F.greatest(F.size("sentences"), F.lit(0)).alias("n"))
    return emit(mask_kinds(annotations), "annotations", "id", F.col("kinds")).unionByName(
        emit(_newest(refs_kinds, "ref_id", "n"), "refs", "ref_id", F.array_repeat(F.lit("sentence"), F.col("n")))
    )
