"""The corpus pipeline: documents in, a seeded mixture of clean documents out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, mixing, secrets, simhash, toxicity
from folioscope.llm.common import discard, staged, table

#: Documents that score this or more are rejected as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted chain scores under TOXIC."""
    model = toxicity.train(toxicity.learnable(docs), toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, keep_text=True)
    return scored.where(scored[scored.columns[-1]] < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars stays that of the original text."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: The fitted models, fingerprints and index can't be said in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's output goes once the next one is written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
            if held is not None:
                discard(held)
            held = docs
    return docs
