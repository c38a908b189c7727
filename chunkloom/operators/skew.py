"""Helpers for groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.session import cut


def fine_bucket(column: str) -> Column:
    """256-way bucket of a string, the same in any engine that has SHA-256."""
    return F.substring(F.sha2(F.col(column), 256), 1, 2)


def group_rank(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Dense 1..n numbering inside each key group, ordered by (bucket of ``order``, ``order``).

    A window over the whole group would sort a hot group in one task. Here each bucket is ranked
    on its own and shifted by the sizes of the buckets before it; only those sizes (at most 256
    rows a group) meet in one window.
    """
    bucketed = df.withColumn("_bucket", fine_bucket(order))
    by_bucket = Window.partitionBy(*keys, "_bucket").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        bucketed.withColumn("_rank", F.row_number().over(by_bucket))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_rank") + F.col("_offset"))
        .drop("_bucket", "_rank", "_offset")
    )


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], row_id: str,
    how: str = "inner", rows_per_part: int = 1_000_000,
) -> DataFrame:
    """Equi-join of many ``left`` rows with a ``right`` side that is unique per key.

    Keys with more than ``rows_per_part`` left rows are split by a hash of ``row_id``; their single
    right row is repeated once per part. There are at most rows / ``rows_per_part`` such keys; adaptive
    execution joins their table by its true size.
    """
    hot = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_part)
        .select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))
    )
    split_left = left.join(hot, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(row_id), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    ).drop("_parts")
    split_right = right.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    ).drop("_parts")
    return split_left.join(split_right, [*keys, "_part"], how).drop("_part")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, rows: int = 5_000) -> DataFrame:
    """Inner equi-join where a key may have many rows on both sides; both are stored tables.

    A key with more than ``rows`` x ``rows`` pairs is a grid of cells of about that size: its left rows are split by a hash
    of ``left_id`` and repeated for each part of the right ones, and the other way round.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    parts = lambda n: F.ceil(F.col(n) / rows).cast("int").alias(n)
    hot = cut(
        size(left, "_l").join(size(right, "_r"), keys)
        .filter(F.col("_l").cast("double") * F.col("_r") > float(rows) * rows).select(*keys, parts("_l"), parts("_r"))
    )

    def side(df: DataFrame, own: str, row_id: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        one = lambda c: F.coalesce(c, F.lit(1))
        return df.join(hot, keys, "left").withColumn(own, F.pmod(F.xxhash64(row_id), one(own_parts).cast("long")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), one(other_parts) - 1))
        ).drop("_l", "_r")

    cells = side(left, "_i", left_id, "_l", "_j", "_r")
    return cells.join(side(right, "_j", right_id, "_r", "_i", "_l"), [*keys, "_i", "_j"]).drop("_i", "_j")
