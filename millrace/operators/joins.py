"""Index joins, lookups, pairings, nearest neighbours, map merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.functions.text import stem
from millrace.operators.batch import RID, row_ids
from millrace.operators.scans import running, running_count
from millrace.runtime import bytes_of

BROADCAST_LIMIT = 64 << 20
BLOCK_CODES = 4096
MATRIX_ROWS = 1 << 14


def refs_with_annotations(refs: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per ref and named annotation; -1 and unknown ids give a null annotation."""
    flat = refs.withColumn("ann_id", F.explode_outer("ann_id"))
    return flat.join(annotations, flat["ann_id"] == annotations["id"], "left")


def lookup(keys: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup with a default for missing keys."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows by an id list ``pos, id``: its order and repeats are kept, a missing id is an error."""
    out = ids.join(df, ids["id"] == df[key], "left")
    return out.where(F.assert_true(F.col(f"{key}").isNotNull(), F.concat(F.lit("no row "), ids["id"].cast("string"))).isNull())


def filter_refs(refs: DataFrame, images: list | None = None, categories: list | None = None, splits: list | None = None) -> DataFrame:
    """Refs of any of the images, any of the categories and any of the splits; an empty list does not filter."""
    out = refs
    if images:
        out = out.where(F.col("image_id").isin(*images))
    if categories:
        out = out.where(F.arrays_overlap("category_id", F.array(*[F.lit(c).cast("bigint") for c in categories])))
    return out.where(F.col("split").isin(*splits)) if splits else out


def split_matches(split: Column, asked: str) -> Column:
    """``testA`` by its letter, ``test`` by containment, others by equality."""
    if asked in ("testA", "testB", "testC"):
        return split.contains(asked[-1])
    return split.contains("test") if asked == "test" else split == asked


def pair_by_stem(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """Inner join of two listings on the file stem, the least path of each, in order."""
    one = lambda d, n: d.groupBy(stem(F.col(path)).alias("stem")).agg(F.min(path).alias(n))
    return one(a, "path_a").join(one(b, "path_b"), "stem").orderBy("stem")


def unprocessed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def nearest_code(df: DataFrame, codebook: DataFrame, vector: str = "embedding") -> DataFrame:
    """The codebook row of least squared distance (ties to the lower code).

    The codebook (``code, cvec``) travels inside one array, so every vector is
    compared in its own row: no pair is ever written out.  Its size is checked;
    a larger codebook is compared block by block and the best block wins.
    """
    if bytes_of(codebook) <= BROADCAST_LIMIT:
        book = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "cvec"))).alias("_book"))
        near = F.array_min(F.transform("_book", lambda c: F.struct(F.round(arrays.squared_distance(F.col(vector), c["cvec"]), 9).alias("d"), c["code"].alias("code"))))
        return df.join(F.broadcast(book), F.lit(True)).withColumn("_n", near).drop("_book").withColumns({"code": F.col("_n.code"), "dist": F.col("_n.d")}).drop("_n")
    blocks = max(1, -(-codebook.count() // BLOCK_CODES))
    books = codebook.groupBy(F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("code", "cvec")).alias("_book"))
    # only a row's number and vector meet every block; equal rows stay apart
    rows = row_ids(df, F.xxhash64(*df.columns))
    keyed = rows.select(RID, F.col(vector).alias("_x")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    near = F.array_min(F.transform("_book", lambda c: F.struct(F.round(arrays.squared_distance(F.col("_x"), c["cvec"]), 9).alias("d"), c["code"].alias("code"))))
    best = keyed.join(books, "_b").select(RID, near.alias("_n")).groupBy(RID).agg(F.min("_n").alias("_n"))
    return rows.join(best, RID).withColumns({"code": F.col("_n.code"), "dist": F.col("_n.d")}).drop("_n", RID)


def residual_codes(df: DataFrame, codebook: DataFrame, depth: int, vector: str = "embedding") -> DataFrame:
    """Codes of every depth: the nearest code, then the nearest to what is left."""
    cur = df.withColumn("codes", F.array().cast("array<bigint>"))
    for _ in range(depth):
        found = nearest_code(cur, codebook, vector).drop("dist")
        book = codebook.select(F.col("code").alias("_c"), F.col("cvec").alias("_v"))
        cur = (
            found.join(F.broadcast(book) if bytes_of(book) <= BROADCAST_LIMIT else book, F.col("code") == F.col("_c"))
            .withColumn("codes", F.concat("codes", F.array(F.col("code").cast("bigint"))))
            .withColumn(vector, F.zip_with(vector, "_v", lambda x, y: x.cast("double") - y.cast("double")))
            .drop("code", "_c", "_v")
        )
    return cur


def _best_of_block(k: int, key_type: str):
    """Arrow batches ``_b, q_id, q_vec, item_id, i_vec`` of one block -> the ``k`` best items of every query of the block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, i = pdf[pdf["i_vec"].isna()], pdf[pdf["q_vec"].isna()]
        if not len(q) or not len(i):
            return pd.DataFrame({"q_id": [], "item_id": [], "sim": []})
        ids, items = q["q_id"].to_numpy(), i["item_id"].to_numpy()
        sims = np.round(np.stack(list(q["q_vec"])).astype(float) @ np.stack(list(i["i_vec"])).astype(float).T, 6)
        sims[ids[:, None] == items[None, :]] = -np.inf
        out = []
        for n in range(len(ids)):
            top = np.lexsort((items, -sims[n]))[: k + 1]
            top = top[sims[n][top] > -np.inf][:k]
            out.append(pd.DataFrame({"q_id": ids[n], "item_id": items[top], "sim": sims[n][top]}))
        return pd.concat(out, ignore_index=True)

    return run


def embed_codes(codes: DataFrame, key: str, column: str, codebook: DataFrame) -> DataFrame:
    """``key, embedding``: the sum of the codebook vectors of a row's codes; -1 and unknown codes add nothing, a row without any has null."""
    flat = codes.select(key, F.explode_outer(column).alias("code"))
    book = codebook.select("code", F.posexplode("cvec").alias("dim", "x"))
    parts = flat.join(F.broadcast(book) if bytes_of(codebook) <= BROADCAST_LIMIT else book, "code", "left").groupBy(key, "dim").agg(F.sum("x").alias("x"))
    put = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("dim").isNotNull(), F.struct("dim", "x")))).alias("s"))
    return put.select(key, F.when(F.size("s") > 0, F.transform("s", lambda t: t["x"])).alias("embedding"))


def top_similar(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 256, chunk: int = 4096) -> DataFrame:
    """The ``k`` most similar items of every query, exactly (ties to the lower id).

    Blocks of about ``block`` queries meet chunks of about ``chunk`` items as one matrix
    product each; a product sends only the ``k`` best of every query on.
    """
    n_q, n_i = max(1, -(-queries.count() // block)), max(1, -(-items.count() // chunk))
    kind, vec = items.schema[key].dataType.simpleString(), "array<double>"
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    left = queries.select(F.pmod(F.xxhash64(key), F.lit(n_q)).cast("int").alias("_q"), all_of(n_i).alias("_i"), F.col(key).alias("q_id"), F.col(vector).cast(vec).alias("q_vec"), none(kind).alias("item_id"), none(vec).alias("i_vec"))
    right = items.select(all_of(n_q).alias("_q"), F.pmod(F.xxhash64(key), F.lit(n_i)).cast("int").alias("_i"), none(kind).alias("q_id"), none(vec).alias("q_vec"), F.col(key).alias("item_id"), F.col(vector).cast(vec).alias("i_vec"))
    both = left.where(F.col("q_vec").isNotNull()).unionByName(right.where(F.col("i_vec").isNotNull()))
    best = both.groupBy("_q", "_i").applyInPandas(_best_of_block(k, kind), f"q_id {kind}, item_id {kind}, sim double")
    order = Window.partitionBy("q_id").orderBy(F.desc("sim"), "item_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similarity_matrix(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, sims``: the cosine of every row with every row of the small side ``b`` (checked), in the order of its keys."""
    if b.count() > MATRIX_ROWS:
        raise ValueError("the second side is too large for a matrix in one row; use top_similar")
    side = b.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).orderBy(key).collect()  # at most MATRIX_ROWS
    m = np.array([r[0] for r in side], dtype=float).reshape(len(side), -1)
    m = m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m

    @F.pandas_udf("array<double>")
    def against(v: pd.Series) -> pd.Series:
        known = [x for x in v if x is not None]
        if not known or not len(m):
            return pd.Series([None] * len(v), dtype=object)
        x = np.stack(known).astype(float)
        sims = iter((x / np.linalg.norm(x, axis=1, keepdims=True)) @ m.T)
        return pd.Series([None if y is None else next(sims) for y in v])

    return a.select(key, against(F.col(vector).cast("array<double>")).alias("sims"))


def paired_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the cosine of two vectors."""
    return pairs.withColumn("sim", arrays.dot(arrays.normalise(F.col(a)), arrays.normalise(F.col(b))))


def annotation_ids(annotations: DataFrame, refs: DataFrame, images: list | None = None, ref_ids: list | None = None) -> DataFrame:
    """``id`` of the annotations of any of the images and of any of the refs; an empty list does not filter."""
    out = annotations.where(F.col("image_id").isin(*images)) if images else annotations
    if ref_ids:
        named = refs.where(F.col("ref_id").isin(*ref_ids)).select(F.explode("ann_id").alias("id")).distinct()
        out = out.join(named, "id", "left_semi")
    return out.select("id").distinct()


def image_ids(images: DataFrame, refs: DataFrame, ref_ids: list | None = None) -> DataFrame:
    """``id`` of the images of the named refs, else of all images."""
    return refs.where(F.col("ref_id").isin(*ref_ids)).select(F.col("image_id").alias("id")).distinct() if ref_ids else images.select("id").distinct()


def evaluation_items(refs: DataFrame, images: DataFrame, split: str, folder: str) -> DataFrame:
    """``ref_id, image, phrase, ann_ids, no_target``: one row per sentence of the refs of a split whose image is known."""
    flat = refs.where(split_matches(F.col("split"), split)).select("ref_id", "image_id", "ann_id", F.explode("sentences").alias("s"))
    known = images.where(F.col("file_name").isNotNull()).select(F.col("id").alias("image_id"), F.concat(F.lit(folder.rstrip("/") + "/"), "file_name").alias("image"))
    return flat.join(known, "image_id").select("ref_id", "image", F.lower(F.trim("s.sent")).alias("phrase"), F.col("ann_id").alias("ann_ids"), (F.col("ann_id") == F.array(F.lit(-1).cast("bigint"))).alias("no_target"))


def merge_checked(a: Column, b: Column) -> Column:
    """Two maps as one; a key both have must have the same value."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    wrong = F.filter(both, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    more = F.map_filter(b, lambda k, _: ~F.array_contains(both, k))
    return F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("values differ at "), F.get(wrong, F.lit(0)).cast("string"))).cast("map<string,string>")).otherwise(F.map_concat(a, more))


def as_of(left: DataFrame, right: DataFrame, key: str, t_left: str, t_right: str, value: str) -> DataFrame:
    """The latest right value (a number, nulls skipped) at or before each left row.

    Union and a distributed scan that holds the last value, no range join and no group in one task.
    """
    none = lambda t: F.lit(None).cast(t)
    both = left.select(key, F.col(t_left).alias("_t"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), none("double").alias("_v")).unionByName(
        right.where(F.col(value).isNotNull()).select(key, F.col(t_right).alias("_t"), F.lit(0).alias("_left"), none(left.schema).alias("_row"), F.col(value).cast("double").alias("_v"))
    )
    here = F.col("_left") == 0
    held = running(both, [key], ["_t", "_left"], F.when(here, F.col("_v")).otherwise(0.0), F.when(here, 0.0).otherwise(1.0), "_held")
    seen = running_count(held.drop("_held_before"), [key], ["_t", "_left"], here.cast("int"), "_seen")
    return seen.where(F.col("_left") == 1).select("_row.*", F.when(F.col("_seen") > 0, F.col("_held")).alias(f"asof_{value}"))


def nearest_index(k: Column, rate: float, source_rate: Column, n: Column) -> Column:
    """The source place nearest to place ``k`` at another rate, null behind the end."""
    at = F.bround(k * source_rate / F.lit(rate)).cast("int")
    return F.when(at < n, at)


def merge_maps(df: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """Array values of equal keys joined in the given order."""
    return df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, values))), lambda s: s[values])).alias(values))


def merge_map_parts(df: DataFrame, key: str, order: str, values: str, size: int) -> DataFrame:
    """``merge_maps`` in parts: one array for every ``size`` consecutive order numbers of a key, so that no array grows with the table.

    The arrays of a key in order of ``part`` are its whole merged value.
    """
    parts = df.withColumn("part", F.floor(F.col(order) / size).cast("bigint")).groupBy(key, "part")
    return parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, values))), lambda s: s[values])).alias(values))


def broadcast_pairs(a: DataFrame, b: DataFrame, on: str, n_a: int, n_b: int) -> DataFrame:
    """Pairs by position; a single row on either side is repeated; other lengths are an error."""
    if n_a == n_b:
        return a.join(b, on)
    if n_b == 1:
        return a.join(F.broadcast(b.drop(on)), F.lit(True))
    if n_a == 1:
        return b.join(F.broadcast(a.drop(on)), F.lit(True))
    raise ValueError(f"cannot pair {n_a} with {n_b} rows")
