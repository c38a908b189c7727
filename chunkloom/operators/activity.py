"""One feed over index, issue, run and delivery events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_activity(rows: DataFrame, kind: str, ts: str, title: Column, repository: str = "repository_id") -> DataFrame:
    return rows.select(
        F.lit(kind).alias("type"), F.col(repository).cast("string").alias("repository_id"),
        title.alias("title"), F.col(ts).alias("ts"),
    )


def feed(*parts: DataFrame) -> DataFrame:
    """Newest first; a range-partitioned global sort."""
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("ts"), "type", "title")
