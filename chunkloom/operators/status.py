"""Counts, overviews and job reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Repository states in which an index job is under way.
ACTIVE = ("queued", "cloning", "indexing")


def counts(repositories: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Indexed files and chunks per repository, zero where there are none."""
    f = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("indexed_file_count"))
    c = chunks.groupBy("repository_id").agg(F.count(F.lit(1)).alias("indexed_chunk_count"))
    return (
        repositories.select("repository_id").join(f, "repository_id", "left").join(c, "repository_id", "left")
        .select(
            "repository_id",
            F.coalesce("indexed_file_count", F.lit(0)).alias("indexed_file_count"),
            F.coalesce("indexed_chunk_count", F.lit(0)).alias("indexed_chunk_count"),
        )
    )


def overview(repositories: DataFrame) -> DataFrame:
    """One row: repositories, ready, active, total chunks."""
    return repositories.agg(
        F.count(F.lit(1)).alias("repositories"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"),
        F.coalesce(F.sum("indexed_chunk_count"), F.lit(0)).cast("long").alias("total_chunks"),
    )


def chunk_rollup(chunks: DataFrame) -> DataFrame:
    """Chunk counts by repository, language and kind with subtotals."""
    return chunks.rollup("repository_id", "language", "kind").agg(F.count(F.lit(1)).alias("chunks"))


def duplicates(chunks: DataFrame) -> DataFrame:
    """Content hashes that occur several times in a repository."""
    return (
        chunks.groupBy("repository_id", "content_hash").agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def job_durations(events: DataFrame) -> DataFrame:
    """Seconds from the first start to the last end of each job.

    ``events``: job_id, ts, event in {started, completed, failed}.
    """
    start = F.min(F.when(F.col("event") == "started", F.col("ts")))
    end = F.max(F.when(F.col("event").isin("completed", "failed"), F.col("ts")))
    return events.groupBy("job_id").agg(
        start.alias("started_at"), end.alias("ended_at"),
        F.count_if(F.col("event") == "failed").alias("failures"),
    ).withColumn(
        "duration_seconds",
        (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6,
    )


def repositories_by_age(repositories: DataFrame) -> DataFrame:
    return repositories.orderBy(F.desc("created_at"), "repository_id")


def issues_by_number(issues: DataFrame) -> DataFrame:
    return issues.orderBy("repository_id", F.desc("number"))


def files_by_path(files: DataFrame) -> DataFrame:
    return files.orderBy("repository_id", "path")
