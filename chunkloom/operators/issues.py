"""Issue synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["repository_id", "github_issue_id"]


def syncable(repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories with an ``owner/repo`` name, and the rejected rest."""
    ok = F.coalesce(F.col("full_name").contains("/"), F.lit(False))
    return repositories.filter(ok), repositories.filter(~ok)


def upsert(existing: DataFrame, feed: DataFrame) -> DataFrame:
    """Whole-row overwrite by (repository_id, github_issue_id), with ``change`` per row.

    A feed that lists an issue twice counts once, by its latest update.
    """
    fields = [c for c in existing.columns if c not in KEY]
    latest = feed.groupBy(*KEY).agg(
        F.max_by(F.struct(*fields), F.struct("github_updated_at", "number")).alias("_new")
    )
    old = existing.select(*KEY, F.struct(*fields).alias("_old"))
    joined = old.join(latest, KEY, "full_outer")
    change = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated")
    )
    row = F.coalesce("_new", "_old")
    return joined.select(*KEY, *[row[f].alias(f) for f in fields], change.alias("change"))


def stats(synced: DataFrame) -> DataFrame:
    return synced.groupBy("repository_id").agg(
        F.count_if(F.col("change") == "created").alias("created"),
        F.count_if(F.col("change") == "updated").alias("updated"),
    )


def sync_issues(feed: DataFrame, existing: DataFrame, repositories: DataFrame) -> dict[str, DataFrame]:
    """Feed rows of syncable repositories merged into the issue table; the others are reported."""
    ok, rejected = syncable(repositories)
    synced = upsert(existing, feed.join(ok.select("repository_id"), "repository_id", "left_semi"))
    return {"issues": synced, "stats": stats(synced.filter("change <> 'kept'")), "rejected": rejected}
