"""Query validation and result projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom.functions.content import citation, label
from chunkloom.schemas import DEFAULT_TOP_K, MAX_TOP_K


def check_top_k(top_k: int = DEFAULT_TOP_K) -> int:
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}, got {top_k}")
    return top_k


def validate_queries(queries: DataFrame) -> DataFrame:
    """Rows with a non-empty query and, where the column exists, a top_k within the limits."""
    valid = queries.filter(F.length("query") > 0)
    if "top_k" in queries.columns:
        top_k = F.coalesce("top_k", F.lit(DEFAULT_TOP_K))
        valid = valid.withColumn("top_k", top_k).filter(F.col("top_k").between(1, MAX_TOP_K))
    return valid


def as_results(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "chunk_id", "file_path", "language", "symbol", "kind",
        "start_line", "end_line", "content", "score",
    )


def as_citations(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "file_path", "start_line", "end_line", "symbol", "kind", "score",
        citation("file_path", "start_line", "end_line").alias("span"),
        label("symbol", "kind").alias("label"),
    )
