"""The registered queries of the training-data operators, and DuckDB SQL where it can say
the same. Each query applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lm, mixing, pii, quality, secrets, simhash, toxicity, warc
from .common import fold, table


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.apply(docs, b"a key of the query; deployments give their own")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.train(docs, labels))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.scored(table(spark, sf_dir, "documents"))
    return out.withColumn("held_out", fold("doc_id", 7) == 2)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), forest)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(table(spark, sf_dir, "pages")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.learnable(docs), toxicity.learnable(labels))
    scored = toxicity.score(docs.select("doc_id", "text"), model, spans=True)
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "toxic_spans",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_benchmark_decontamination, op3_simhash_near_dedup, op4_quality_rules, op5_lm_scores,
        op6_secret_scan, op7_warc, op8_mixing, op9_license_scan, op10_toxicity,
    )
}
ORACLES: dict[str, str] = {
    "op7_warc": warc.ORACLE,
    "op8_mixing": mixing.ORACLE.replace("{docs}", "documents").replace("{seed}", "42"),
}
