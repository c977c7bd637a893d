"""Session helpers: table reading, shared working folder, materialised stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (Spark's own file distribution)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="millrace-pkg-"))
        for p in root.rglob("*.py"):
            to = at / "src" / root.name / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(p, to)
        spark.sparkContext.addPyFile(shutil.make_archive(str(at / "millrace"), "zip", at / "src"))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where all executors are threads of one machine (tests) may it be unset: a
    temporary folder is made then.  On a cluster that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    global _local
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _local


_local: str | None = None


def stage_dir(spark: SparkSession) -> str:
    """The folder of this application's stages."""
    at = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if not _ending:
        atexit.register(release, spark)
        _ending.append(at)
    return at


_ending: list[str] = []


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any URI Spark can read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> None:
    """Delete the stages of this application; results that read them must have been consumed.  Runs by itself at exit."""
    try:
        fs, at = hadoop_path(spark, f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}")
        fs.delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone; its folder is left to the cluster's own cleaning
        return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of any executor, and unlike an eager
    ``checkpoint()`` runs the last stage once and stores columns compressed.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit repartition: the session's shuffle width."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bytes_of(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, used to guard broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only while the plan's estimated size stays under ``limit``."""
    return F.broadcast(df) if bytes_of(df) <= limit else df
