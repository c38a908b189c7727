"""Training-data pipeline: five stages from raw documents to a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
documents. A stage works on all rows its predecessor kept and returns whole rows of ``docs``; the last one returns
the mix. Rows share the fate of their doc_id in the stages that look for groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.llm import decontam, mixing, neardup, pii, quality
from chunkloom.session import cut

# SQL can't state the hashed likelihood ratio of the first stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``ids`` (doc_id). The ids are stored first, so the join is planned by their true size."""
    return docs.join(cut(ids.filter("doc_id IS NOT NULL").distinct()), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; documents without text stay."""
    return _without(docs, neardup.near_duplicates(docs).filter("NOT kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), "text")
    return _without(docs, decontam.contamination(docs, items).filter("contaminated").select("doc_id"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    done = pii.replace(docs, pii.key_of(spark))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
    ("PII", private_data), ("mixing sources to target weights", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
