"""Name-status diff text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def read_name_status(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Diff entries from ``value`` lines (``spark.read.text``); unknown codes and blanks are dropped."""
    fields = F.split("value", "\t", -1)
    code = F.get(fields, F.lit(0))
    first, second = F.get(fields, F.lit(1)), F.get(fields, F.lit(2))
    status = (
        F.when(code.startswith("R"), "renamed").when(code.startswith("C"), "copied")
        .when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted")
    )
    moves = F.col("status").isin("renamed", "copied")
    return (
        lines.withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select(
            *keep, "status",
            F.when(moves, second).otherwise(first).alias("path"),
            F.when(moves, first).alias("old_path"),
        )
        .filter(F.col("path").isNotNull())
    )
