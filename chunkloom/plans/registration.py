"""Registering repositories by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom.functions import full_name, repository_name


def register(urls: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New repositories from ``url`` rows: one per address, addresses already known are left out.

    ``urls`` may carry ``seq``: the last row of an address wins (its values travel with the row).
    """
    rows = urls if "seq" in urls.columns else urls.withColumn("seq", F.lit(0))
    extra = [c for c in rows.columns if c not in ("url", "seq")]
    latest = rows.groupBy("url").agg(F.max(F.struct("seq", *extra)).alias("_row"))
    fresh = latest.select("url", *[F.col(f"_row.{c}").alias(c) for c in extra])
    if existing is not None:
        fresh = fresh.join(existing.select("url"), "url", "left_anti")
    return fresh.select(
        F.sha2("url", 256).alias("repository_id"), "url",
        repository_name("url").alias("name"), full_name("url").alias("full_name"),
        F.lit("pending").alias("status"), *extra,
    )
