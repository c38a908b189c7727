"""Index progress per repository, folded from events.

The fold keeps a bounded set of events per repository (the last of each kind and the eight last
files since the newest run started). That set is itself a list of events, so folding is associative:
a stream reduces its stored set together with each new batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.schemas import RECENT_FILES

# Event names.
QUEUED = "index.queued"
STARTED = "index.started"
DISCOVERED = "index.files.discovered"
FILE = "index.file.completed"
COMPLETED = "index.completed"
FAILED = "index.failed"


def reduce_events(events: DataFrame) -> DataFrame:
    """At most 13 events per repository that decide its progress."""
    per_kind = Window.partitionBy("repository_id", "event").orderBy(F.desc("ts"), F.desc("data.path"))
    recent = events.withColumn("_r", F.row_number().over(per_kind)).filter(F.col("_r") <= RECENT_FILES)
    recent = recent.filter((F.col("event") == FILE) | (F.col("_r") == 1)).drop("_r")
    start = recent.filter(F.col("event").isin(QUEUED, STARTED)).groupBy("repository_id").agg(F.max("ts").alias("_start"))
    return recent.join(start, "repository_id", "left").filter(
        F.col("_start").isNull() | (F.col("ts") >= F.col("_start"))
    ).drop("_start")


def fold(reduced: DataFrame) -> DataFrame:
    """Stage, discovered count, recent files and completion per repository from reduced events."""
    is_ = lambda name: F.col("event") == name
    last = lambda name, value: F.max_by(F.when(is_(name), F.col(value)), F.when(is_(name), F.col("ts")))
    rows = reduced.groupBy("repository_id").agg(
        last(DISCOVERED, "data.count").alias("discovered_count"),
        F.array_sort(F.collect_list(F.when(is_(FILE), F.struct("ts", "data.path", "data.status"))), lambda a, b: (
            F.when(F.struct(a["ts"], a["path"]) > F.struct(b["ts"], b["path"]), -1).otherwise(1)
        )).alias("recent_files"),
        last(COMPLETED, "data").alias("completed"),
        last(FAILED, "data.error").alias("error"),
        F.max_by(F.when(F.col("event").isin(COMPLETED, FAILED), F.col("event")), F.when(F.col("event").isin(COMPLETED, FAILED), F.col("ts"))).alias("_end"),
        F.count_if(is_(DISCOVERED)).alias("_discovered"), F.count_if(is_(STARTED)).alias("_started"),
        F.max("ts").alias("last_event_at"),
    )
    stage = (
        F.when(F.col("_end") == FAILED, "failed").when(F.col("_end") == COMPLETED, "ready")
        .when(F.size("recent_files") > 0, "processing").when(F.col("_discovered") > 0, "discovering")
        .when(F.col("_started") > 0, "fetching").otherwise("connecting")
    )
    return rows.withColumn("stage", stage).drop("_end", "_discovered", "_started")


def latest(events: DataFrame) -> DataFrame:
    return fold(reduce_events(events))
