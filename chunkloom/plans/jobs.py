"""Index jobs of many repositories at once: what each has to do, its statistics, its errors, its progress events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions import detect_language
from chunkloom.operators import progress
from chunkloom.plans.index import Corpus, diff_of, incremental_index
from chunkloom.schemas import MAX_FILE_BYTES, PROGRESS
from chunkloom.session import cut

COUNTERS = ["files_discovered", "files_added", "files_modified", "files_renamed", "files_deleted", "files_skipped",
            "total_chunks", "chunks_created", "chunks_deleted", "n_errors"]


@dataclass
class JobResult:
    corpus: Corpus
    report: DataFrame      # a row per job
    file_results: DataFrame  # a row per file that was parsed
    errors: DataFrame      # a row per file that failed
    events: DataFrame      # progress events of the jobs


def file_results(chunk_ops: DataFrame) -> DataFrame:
    """Distinct chunk contents of every parsed file, and how many of its chunks were embedded and deleted."""
    stays = F.col("op") != "delete"
    return chunk_ops.groupBy("repository_id", "file_id").agg(
        F.count_distinct(F.when(stays, F.col("content_hash"))).alias("total_chunks"),
        F.count_if(F.col("op") == "embed").alias("chunks_embedded"),
        F.count_if(~stays).alias("chunks_deleted"),
    )


def _events(report: DataFrame, decided: DataFrame, at: Column) -> DataFrame:
    fields = [part.split(":") for part in PROGRESS.split("struct<")[1].rstrip(">").split(",")]

    def rows(df: DataFrame, event: str, order: int, **data: Column) -> DataFrame:
        cells = [data.get(name, F.lit(None)).cast({"long": "bigint"}.get(kind, kind)).alias(name) for name, kind in fields]
        return df.select("repository_id", (at + F.make_dt_interval(secs=F.lit(order))).alias("ts"), F.lit(event).alias("event"), F.struct(*cells).alias("data"))

    worked = report.filter("NOT no_op")
    completed = {c: F.col(c) for c in ("no_op", "fell_back_to_full_index", "files_discovered", "files_added", "files_modified",
                                       "files_deleted", "files_renamed", "chunks_created", "chunks_deleted")}
    return (
        rows(report, progress.STARTED, 0)
        .unionByName(rows(worked, progress.DISCOVERED, 1, count=F.col("files_discovered")))
        .unionByName(rows(decided, progress.FILE, 2, path=F.col("path"), status=F.col("status")))
        .unionByName(rows(report, progress.COMPLETED, 3, errors=F.col("n_errors"), **completed))
    )


def run_jobs(
    jobs: DataFrame, files: DataFrame, prior: Corpus, prior_snapshot: DataFrame | None = None,
    embed: Callable[[Column], Column] | None = None, max_bytes: int = MAX_FILE_BYTES, at: Column | None = None,
) -> JobResult:
    """Bring every repository of ``jobs`` (repository_id, base_commit, after_commit; one row each) to its new snapshot in ``files``.

    Equal commits are a job without work (``no_op``); without a base commit the whole snapshot is indexed
    (``fell_back_to_full_index``), and its counters are those of that work. A file whose content is null could not be
    read: it becomes a row of ``errors``, its indexed state stays as it is and the job goes on. Repositories without a
    job keep their state. ``at`` is the time of the events, which follow each other by a second a stage.
    """
    key = ["repository_id", "path"]
    told = cut(jobs.select(
        "repository_id", "base_commit", "after_commit",
        F.coalesce(F.col("base_commit") == F.col("after_commit"), F.lit(False)).alias("no_op"), F.col("base_commit").isNull().alias("fell_back_to_full_index"),
    ))
    due = told.filter("NOT no_op").select("repository_id")
    mine = files.join(due, "repository_id", "left_semi")
    broken = cut(mine.filter(F.col("content").isNull()).select(*key))
    readable = mine.filter(F.col("content").isNotNull())
    compared = prior.files.join(due, "repository_id", "left_semi").join(broken, key, "left_anti")
    diff = cut(diff_of(compared, readable, prior_snapshot))
    # The counters of files and of repositories both read the chunk operations.
    result = incremental_index(diff, readable, prior, embed, max_bytes, stored=True)

    errors = broken.filter(detect_language("path").isNotNull()).withColumn("error", F.lit("content is missing"))
    parsed = cut(file_results(result.chunk_ops))
    report = (
        told.join(result.stats.drop("no_op"), "repository_id", "left")
        .join(parsed.groupBy("repository_id").agg(F.sum("total_chunks").alias("total_chunks")), "repository_id", "left")
        .join(errors.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_errors")), "repository_id", "left")
        .select("repository_id", "base_commit", "after_commit", "no_op", "fell_back_to_full_index",
                *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    )
    report = cut(report)
    return JobResult(result.corpus, report, parsed, errors, _events(report, result.decisions, F.current_timestamp() if at is None else at))
