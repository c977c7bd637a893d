"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import crosssplit, defects, leakage, lexicon, mixture, packing, sentences
from millrace.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.found(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents"))


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.labels(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")).select("conv_id", "turn", "defect", F.round("posterior", 6).alias("posterior"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.report(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.found(table(spark, sf_dir, "refs"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.report(table(spark, sf_dir, "refs"))


def p3_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "pack_limits"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p3_packed(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "refs"), table(spark, sf_dir, "conversations"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(table(spark, sf_dir, "refs"), table(spark, sf_dir, "conversations"))


def p5_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.reparameterised(table(spark, sf_dir, "refs"), table(spark, sf_dir, "conversations"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_labels, p1_report, p2_found, p2_report, p3_packed, p3_report, p5_found, p5_report, p5_reparameterised,
        p7_ids, p8_mixture, p8_shares, p9_found,
    )
}
SQL: dict[str, str] = {}
