"""Pluggable reranking of search hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions import tokenize


def apply(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Replace ``score`` by ``scorer(query, content)``; identity without a scorer.

    A scorer is any function of two columns: a Pandas UDF over a model, or an expression. Adds
    ``rerank_score`` (null for the identity), by which the final order is taken first.
    """
    if scorer is None:
        return hits.withColumn("rerank_score", F.lit(None).cast("double"))
    rescored = hits.withColumn("rerank_score", scorer(F.col("query"), F.col("content")).cast("double"))
    return rescored.withColumn("score", F.col("rerank_score"))


def token_overlap(query: Column, content: Column) -> Column:
    """Share of distinct query tokens that occur in the content."""
    asked = F.array_distinct(tokenize(query))
    return F.when(
        F.size(asked) > 0, F.size(F.array_intersect(asked, tokenize(content))) / F.size(asked)
    ).otherwise(0.0)
