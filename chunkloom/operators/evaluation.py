"""Quality of plans and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def plan_cases(cases: DataFrame) -> DataFrame:
    """Precision and recall of predicted files, and whether every citation was retrieved.

    ``cases``: case_id, expected, predicted, cited, retrieved (arrays of paths).
    """
    hits = F.size(F.array_intersect("expected", "predicted"))
    ratio = lambda c: F.when(F.size(F.array_distinct(c)) > 0, hits / F.size(F.array_distinct(c))).otherwise(0.0)
    return cases.select(
        "case_id", ratio("predicted").alias("precision"), ratio("expected").alias("recall"),
        (F.size(F.array_except("cited", "retrieved")) == 0).alias("citations_valid"),
    )


def plan_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"),
        F.count_if(~F.col("citations_valid")).alias("hallucinations"),
    )


def retrieval(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Recall@k and reciprocal rank per query. ``expected``: query_id, chunk_id."""
    total = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    found = hits.filter(F.col("rank") <= k).join(expected, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("rank").alias("first_rank")
    )
    return total.join(found, "query_id", "left").select(
        "query_id", (F.coalesce("n_found", F.lit(0)) / F.col("n_expected")).alias("recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )
