"""Scans and sinks: metadata files by suffix, catalogs with rates, listings, manifests, sharded and resumable writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import extension, stem
from millrace.runtime import hadoop_path

FORMATS = {"json": ("json", {"multiLine": "true"}), "jsonl": ("json", {}), "csv": ("csv", {"header": "true", "inferSchema": "true", "multiLine": "true", "escape": '"'}), "parquet": ("parquet", {})}


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_metadata(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A metadata table by suffix: one JSON array, JSON lines (blank lines are skipped), parquet; anything else is CSV."""
    fmt, options = FORMATS.get(_suffix(path), FORMATS["csv"])
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema).option("inferSchema", "false")
    return reader.load(path)


def read_split(spark: SparkSession, path_at_split: str, default: str = "train") -> DataFrame:
    """``path@split``: the rows of one split; a directory is read by the suffix of its first file."""
    path, _, asked = path_at_split.partition("@")
    fs, at = hadoop_path(spark, path)
    if fs.exists(at) and fs.getFileStatus(at).isDirectory():
        names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(at)) if not n.startswith((".", "_")))
        fmt, options = FORMATS.get(_suffix(names[0]) if names else "parquet", FORMATS["csv"])
        df = spark.read.format(fmt).options(**options).load(path)
    else:
        df = read_metadata(spark, path)
    return df.where(F.col("split") == (asked or default)) if "split" in df.columns else df


def catalog_entry(name: str, catalog: dict[str, dict]) -> tuple[str, float, dict]:
    """``name%NN`` -> (name, rate, entry); an unknown name is an error."""
    base, _, pct = name.partition("%")
    if base not in catalog:
        raise ValueError(f"unknown dataset {base!r}")
    return base, int(pct) / 100 if pct else 1.0, catalog[base]


def read_catalog(spark: SparkSession, names: str, catalog: dict[str, dict], key: str, seed: int = 0) -> DataFrame:
    """A comma list of catalog names, sampled by their rates, tagged with ``data_path`` and joined.

    Rates below one keep the rows of least hash (the same at every run), rates
    above one repeat every row.
    """
    frames = []
    for name in names.split(","):
        base, rate, entry = catalog_entry(name.strip(), catalog)
        df = read_metadata(spark, entry["path"]).withColumn("data_path", F.lit(base))
        if rate < 1:
            df = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(rate * 1_000_000))
        elif rate > 1:
            df = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(int(rate))))).drop("_k")
        frames.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def list_files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """``path, name, stem, ext, length`` of the files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    df = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("ext"), "length")
    return df.where(F.col("ext").isin(*suffixes)) if suffixes else df


def pair_listing(listing: DataFrame, ext_a: str, ext_b: str) -> DataFrame:
    """Files of two suffixes with one stem in one folder."""
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    a = listing.where(F.col("ext") == ext_a).select(folder.alias("folder"), "stem", F.col("path").alias("path_a"))
    b = listing.where(F.col("ext") == ext_b).select(folder.alias("folder"), "stem", F.col("path").alias("path_b"))
    return a.join(b, ["folder", "stem"])


def read_manifest(spark: SparkSession, path: str, prefix: str, column: str, order: str | None = None, first: int | None = None) -> DataFrame:
    """A JSON manifest with a path prefix; ``first`` is the feature of a small trial run."""
    df = read_metadata(spark, path).withColumn(column, F.concat_ws("/", F.lit(prefix.rstrip("/")), column))
    return df.orderBy(order or column).limit(first) if first else df


def read_panoptic(spark: SparkSession, path: str, things: dict[int, int], stuff: dict[int, int]) -> DataFrame:
    """One row per image with its segments' categories mapped to contiguous ids."""
    df = read_metadata(spark, path).select(F.explode("annotations").alias("a")).select("a.*")
    maps = {n: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<int,int>") for n, m in (("t", things), ("s", stuff))}

    def remap(s: Column) -> Column:
        thing, other = F.try_element_at(maps["t"], s["category_id"].cast("int")), F.try_element_at(maps["s"], s["category_id"].cast("int"))
        return s.withField("isthing", thing.isNotNull()).withField("category_id", F.coalesce(thing, other).cast("bigint"))

    return df.withColumn("segments_info", F.transform("segments_info", remap))


def read_referring(spark: SparkSession, refs: str, parts: dict[str, str] | str) -> dict[str, DataFrame]:
    """A referring-expression set as tables ``refs, images, annotations, categories``.

    ``refs`` is a list of refs in any format; ``parts`` one JSON file with a list under
    each name, or a path for each of them.  Refs without lists of annotations and
    categories get lists of one.  A repeated ref counts once (the greatest by content).
    """
    table = spark.read.json(refs) if _suffix(refs) != "parquet" else spark.read.parquet(refs)
    for c in ("ann_id", "category_id"):
        if c in table.columns and table.schema[c].dataType.typeName() != "array":
            table = table.withColumn(c, F.array(c))
    rest = [c for c in table.columns if c != "ref_id"]
    table = table.groupBy("ref_id").agg(F.max(F.struct(*rest)).alias("_r")).select("ref_id", "_r.*")
    if isinstance(parts, str):
        whole = spark.read.option("multiLine", "true").json(parts)
        lists = {n: whole.select(F.inline(n)) for n in ("images", "annotations", "categories") if n in whole.columns}
    else:
        lists = {n: spark.read.json(p) if _suffix(p) != "parquet" else spark.read.parquet(p) for n, p in parts.items()}
    return {"refs": table, **lists}


def decode_data_uri(text: Column) -> Column:
    """The bytes behind ``data:...;base64,``, null for any other text."""
    return F.when(text.rlike("^data:[^,]*;base64,"), F.unbase64(F.regexp_replace(text, "^data:[^,]*,", "")))


def read_parameter_names(df: DataFrame) -> DataFrame:
    """``file, name, dtype, shape`` of safetensors files (``path, content``) from their headers: the weights are not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                size = int.from_bytes(content[:8], "little")
                head = json.loads(bytes(content[8 : 8 + size]))
                rows += [(path, n, t["dtype"], [int(x) for x in t["shape"]]) for n, t in head.items() if n != "__metadata__"]
            yield pd.DataFrame(rows, columns=["file", "name", "dtype", "shape"])

    return df.select("path", "content").mapInPandas(run, "file string, name string, dtype string, shape array<bigint>")


def read_file_metadata(df: DataFrame) -> DataFrame:
    """``file, metadata`` of safetensors files (``path, content``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [json.loads(bytes(c[8 : 8 + int.from_bytes(c[:8], "little")])) for c in batch["content"]]
            yield pd.DataFrame({"file": batch["path"], "metadata": [list((h.get("__metadata__") or {}).items()) for h in heads]})

    pairs = df.select("path", "content").mapInPandas(run, "file string, metadata array<struct<k:string,v:string>>")
    return pairs.select("file", F.map_from_entries("metadata").alias("metadata"))


def reference_blocks(spec: Column) -> Column:
    """Tagged union of references: the path field is named by ``type``; an unknown type is an error."""
    path = F.when(spec["type"] == "image", spec["image"]).when(spec["type"].isin("video", "video_audio"), spec["video"]).when(spec["type"] == "audio", spec["audio"])
    return F.struct(spec["type"].alias("type"), F.when(spec["type"].isin("image", "video", "video_audio", "audio"), path).otherwise(F.raise_error(F.concat(F.lit("unknown type "), spec["type"]))).alias("path"))


def decode_files(df: DataFrame, decode: Callable[[bytes], dict], schema: str) -> DataFrame:
    """Binary contents decoded by a user function in Arrow batches; a file that fails gives nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, c in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append({"path": p, **decode(c)})
                except Exception:  # noqa: BLE001 - a bad file is a null row
                    rows.append({"path": p})
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in f"path string, {schema}".split(", ")])

    return df.select("path", "content").mapInPandas(run, f"path string, {schema}")


def schema_only(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Names and types from the footers, no data."""
    return spark.read.parquet(path).dtypes


def write_stage(df: DataFrame, path: str, keep: list[str] | None = None, drop: tuple[str, ...] = ()) -> None:
    """A cached stage: needed columns only, one file set per task."""
    cols = [c for c in (keep or df.columns) if c in df.columns and c not in drop]
    df.select(*cols).write.mode("overwrite").parquet(path)


def write_same_format(df: DataFrame, path: str) -> None:
    fmt, _ = FORMATS.get(_suffix(path), FORMATS["csv"])
    writer = df.write.mode("overwrite").format("json" if fmt == "json" else fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_shards(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """JSON shards of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def resume_write(df: DataFrame, path: str, key: str) -> int:
    """Append the rows that have no output yet; returns how many were written."""
    spark = df.sparkSession
    fs, at = hadoop_path(spark, path)
    parts = [f for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet")] if fs.exists(at) else []
    todo = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if parts else df
    seen = Observation()
    todo.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def append_metrics(spark: SparkSession, path: str, step: int, values: dict[str, float]) -> None:
    """Metrics of one step as long rows ``step, key, value``."""
    spark.createDataFrame([(step, k, float(v)) for k, v in values.items()], "step int, key string, value double").write.mode("append").parquet(path)


def latest_step(spark: SparkSession, folder: str, form: str = "global_step_{}") -> tuple[str, int] | None:
    """(path, step) of the newest step folder below ``folder``, None where there is none."""
    fs, at = hadoop_path(spark, folder)
    if not fs.exists(at):
        return None
    head, tail = form.split("{}")
    steps = []
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        middle = name[len(head) : len(name) - len(tail)]
        if f.isDirectory() and name.startswith(head) and name.endswith(tail) and middle.isdigit():
            steps.append((int(middle), f.getPath().toString()))
    return (max(steps)[1], max(steps)[0]) if steps else None


def steps_to_save(steps: DataFrame, step: str, every: int, last: int) -> DataFrame:
    """Steps at which a checkpoint is due: every so many, and the last one where it is none of them."""
    return steps.where((F.col(step) % every == 0) | (F.col(step) == last))


def write_predictions(df: DataFrame, folder: str, name: Column) -> None:
    """One JSON file set per ``name``, so that a later run can tell what is there."""
    df.withColumn("_name", name).write.mode("append").partitionBy("_name").json(folder)


def fan_out(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """One result to several sinks."""
    for sink in sinks:
        sink(df)


def add_predictions(rows: DataFrame, predictions: DataFrame, key: str, samples: str, field: str) -> DataFrame:
    """A prediction of every inner sample (``key, pos, value``) written into the nested array."""
    per = predictions.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_p"))
    return rows.join(per, key, "left").withColumn(samples, F.transform(samples, lambda s, i: s.withField(field, F.try_element_at(F.col("_p"), i)))).drop("_p")


def write_run_config(path: str, config: dict) -> None:
    with open(path, "w") as f:
        json.dump(config, f, indent=2, sort_keys=True, default=str)
