"""Reciprocal rank fusion of any number of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from chunkloom.schemas import RRF_K


def rrf(*ranked: DataFrame, keys: tuple[str, ...] = ("repository_id", "query_id")) -> DataFrame:
    """Sum of 1 / (60 + rank) per item, rank from 1; the rank in each list is kept as ``rank_<i>``."""
    lists = [
        r.select(*keys, "chunk_id", F.lit(i).alias("_list"), F.col("rank").alias("_rank")) for i, r in enumerate(ranked)
    ]
    merged = reduce(DataFrame.unionByName, lists)
    return merged.groupBy(*keys, "chunk_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("_rank"))), 12).alias("fused_score"),
        *[F.max(F.when(F.col("_list") == i, F.col("_rank"))).alias(f"rank_{i}") for i in range(len(lists))],
    )
