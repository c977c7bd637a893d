"""References to records that do not exist, from signed counts kept per key.

Two small tables are kept from batch to batch (``Counts``):

* ``referrers``: per source row and field the keys it names, taken from the
  earliest row of the source key;
* ``keys``: per target key the signed counts ``refs`` and ``alive``.

A batch of change rows becomes signed deltas against the kept state.  A source
row adds +1 to each key it names; when an earlier row of the same source key
turns up, the keys named until now get -1 first.  A target key adds +1 to its
existence when it arrives or comes back, -1 when its newest version is a
deletion, 0 for a repeat or a version that is not the newest.  ``merge`` adds
the deltas up, so batches in any division and order leave the same state, and
the whole history is simply one batch on an empty state.

Every sum combines on the map side, so a key that holds a third of all
references arrives as one row per task.  Keys with positive references and zero
existence are the current orphans; keys that arrived after a referring row are
the late ones.  Only these are joined back to the referrers: the few keys named
by more than 1/10,000 of all references (so at most 10,000 keys) by broadcast,
the others by a shuffle in which no key is that large.

Defined results: null keys, null/empty arrays and -1 refer to nothing; a null
``is_deleted`` means not deleted; without an ``ingested_at`` a row counts as
never late; a null target key never exists; repeats count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

HOT = 10_000  # a key is hot above this share (1/HOT) of all references
_AT = "timestamp_ntz"


@dataclass(frozen=True)
class Link:
    """``src`` rows (key ``src_key``) whose ``field`` names ``target_key`` of ``target``."""

    src_table: str
    src: DataFrame
    src_key: str
    field: str
    target_table: str
    target: DataFrame
    target_key: str
    none: int | None = None  # a value that refers to nothing


@dataclass(frozen=True)
class Counts:
    """The kept state: ``referrers`` (src_table, src_id, field, target_table, first) and ``keys`` (target_table, target, refs, alive, newest, first_at, first_ref)."""

    referrers: DataFrame
    keys: DataFrame


def _first_row(link: Link) -> DataFrame:
    """Candidates for the row that counts of each source key; the arrival time comes first, the named keys break ties."""
    one = link.src.schema[link.field].dataType.typeName() != "array"
    named = F.array_compact(F.array(link.field) if one else F.col(link.field))
    named = F.array_sort(F.array_distinct(named if link.none is None else F.filter(named, lambda x: x != F.lit(link.none))))
    at = F.col("ingested_at").cast(_AT)
    return link.src.where(F.col(link.src_key).isNotNull()).select(
        F.lit(link.src_table).alias("src_table"), F.col(link.src_key).cast("bigint").alias("src_id"), F.lit(link.field).alias("field"), F.lit(link.target_table).alias("target_table"),
        F.struct(at.isNull().alias("u"), at.alias("at"), F.coalesce(named.cast("array<string>"), F.array().cast("array<string>")).alias("named")).alias("first"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _referrers(links: list[Link], old: DataFrame | None) -> DataFrame:
    """The new referrers with ``was``, the row that counted until now (null for a new source key)."""
    rows = _union([_first_row(x) for x in links]).withColumn("old", F.lit(False))
    if old is not None:
        rows = rows.unionByName(old.withColumn("old", F.lit(True)))
    return rows.groupBy("src_table", "src_id", "field", "target_table").agg(F.min("first").alias("first"), F.min(F.when(F.col("old"), F.col("first"))).alias("was"))


def reference_deltas(referrers: DataFrame) -> DataFrame:
    """Signed reference counts ``target_table, target, d_refs, ref_at`` of the source rows that are new or have changed."""
    changed = referrers.where(~F.col("first").eqNullSafe(F.col("was")))
    plus = F.transform("first.named", lambda k: F.struct(k.alias("target"), F.lit(1).cast("bigint").alias("d_refs"), F.col("first.at").alias("ref_at")))
    minus = F.transform("was.named", lambda k: F.struct(k.alias("target"), F.lit(-1).cast("bigint").alias("d_refs"), F.lit(None).cast(_AT).alias("ref_at")))
    both = F.when(F.col("was").isNull(), plus).otherwise(F.concat(plus, minus))
    return changed.select("target_table", F.inline(both))


def merge(keys: DataFrame | None, references: DataFrame, links: list[Link]) -> DataFrame:
    """The state of the keys after a batch: kept counts plus the signed deltas of references and existence, in one shuffle."""
    none = lambda t: F.lit(None).cast(t)
    version, big = f"struct<at:{_AT},gone:boolean>", lambda n: F.lit(n).cast("bigint")
    parts = [references.select("target_table", "target", F.col("d_refs").alias("refs"), big(0).alias("alive"), none(version).alias("was"), none(version).alias("newest"), none(_AT).alias("first_at"), F.col("ref_at").alias("first_ref"))]
    for name, df, key in {x.target_table: (x.target_table, x.target, x.target_key) for x in links}.values():
        at = F.col("ingested_at").cast(_AT)
        row = F.struct(at.alias("at"), F.coalesce("is_deleted", F.lit(False)).alias("gone"))  # of one instant, a deletion wins
        parts.append(df.where(F.col(key).isNotNull()).select(
            F.lit(name).alias("target_table"), F.col(key).cast("string").alias("target"), big(0).alias("refs"), big(0).alias("alive"),
            none(version).alias("was"), row.cast(version).alias("newest"), at.alias("first_at"), none(_AT).alias("first_ref"),
        ))
    if keys is not None:
        parts.append(keys.withColumn("was", F.col("newest")))
    summed = _union(parts).groupBy("target_table", "target").agg(
        F.sum("refs").alias("refs"), F.sum("alive").alias("alive"), F.max("was").alias("was"), F.max("newest").alias("newest"), F.min("first_at").alias("first_at"), F.min("first_ref").alias("first_ref")
    )
    here = lambda c: F.coalesce((~c["gone"]).cast("bigint"), big(0))
    delta = here(F.col("newest")) - here(F.col("was"))  # +1 arrived or came back, -1 deleted
    return summed.select("target_table", "target", "refs", (F.col("alive") + delta).alias("alive"), "newest", "first_at", "first_ref")


def apply_batch(state: Counts | None, links: list[Link]) -> Counts:
    """The state after the change rows of ``links`` (any part of the history, in any order)."""
    referrers = materialize(_referrers(links, state.referrers if state else None), "p6-referrers")
    keys = materialize(merge(state.keys if state else None, reference_deltas(referrers), links), "p6-keys")
    return Counts(referrers.drop("was"), keys)


def current_orphans(state: Counts) -> DataFrame:
    """``src_table, src_id, field, target, state, at`` of every reference that does not hold now."""
    bad = state.keys.where((F.col("refs") > 0) & ((F.col("alive") <= 0) | (F.col("first_at") > F.col("first_ref"))))
    total = state.keys.agg(F.sum("refs")).first()[0] or 0
    bar = max(1_000, total // HOT)
    flat = state.referrers.select("src_table", "src_id", "field", "target_table", F.col("first.at").alias("at"), F.explode("first.named").alias("target"))
    side = bad.select("target_table", "target", "refs", "alive", F.col("newest").isNull().alias("never"), "first_at")
    on = ["target_table", "target"]
    hits = flat.join(F.broadcast(side.where(F.col("refs") > bar)), on).unionByName(
        flat.join(F.broadcast(state.keys.where(F.col("refs") > bar).select(*on)), on, "left_anti").join(side.where(F.col("refs") <= bar), on)
    )
    kind = F.when(F.col("never"), "missing").when(F.col("alive") <= 0, "deleted").when(F.col("first_at") > F.col("at"), "late")
    return hits.select("src_table", "src_id", "field", "target", kind.alias("state"), "at").where(F.col("state").isNotNull())


def orphans(links: list[Link]) -> DataFrame:
    """The current orphans after the whole history as one batch."""
    return current_orphans(apply_batch(None, links))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, state and month of arrival."""
    return found.groupBy("src_table", "field", "state", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n_orphans"))
