"""Run status: which events are legal and where every run stands.

Events: started, awaiting, failed set the status whatever it was; approve and reject are legal only
while a run awaits approval. Illegal events are kept as rejected rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Event to status.
SETS = {"started": "running", "awaiting": "awaiting_approval", "failed": "failed"}
DECISIONS = {"approve": "approved", "reject": "rejected"}


def judge(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Add ``legal`` and ``status`` (after the event) to ``run_id, ts, seq, event`` rows.

    A decision is legal when the last status-setting event before it is ``awaiting`` and no decision
    came between. Windows run inside one hour of one run; hours are chained through one small row
    each, so a run of any length is spread over tasks. ``state`` (run_id, status) is where runs stood
    before these events.
    """
    rows = events.filter(F.col("event").isin(*SETS, *DECISIONS))
    at = F.struct("ts", "seq")
    sets = F.col("event").isin(*SETS)
    rows = rows.withColumn("_hour", F.floor(F.unix_seconds("ts") / 3600))
    per_hour = rows.groupBy("run_id", "_hour").agg(
        F.count_if(sets).alias("_n"), F.max_by(F.when(sets, F.col("event")), F.when(sets, at)).alias("_last")
    )
    chain = Window.partitionBy("run_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = per_hour.select(
        "run_id", "_hour", F.coalesce(F.sum("_n").over(chain), F.lit(0)).alias("_n_before"),
        F.last("_last", ignorenulls=True).over(chain).alias("_last_before"),
    )
    inside = Window.partitionBy("run_id", "_hour").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("_n_in", F.sum(sets.cast("int")).over(inside))
        .withColumn("_last_in", F.last(F.when(sets, F.col("event")), ignorenulls=True).over(inside))
        .join(before, ["run_id", "_hour"])
        .withColumn("_segment", F.col("_n_before") + F.col("_n_in"))
        .withColumn("_since", F.coalesce("_last_in", "_last_before"))
    )
    if state is not None:
        placed = placed.join(state.select("run_id", F.col("status").alias("_prior")), "run_id", "left")
    else:
        placed = placed.withColumn("_prior", F.lit(None).cast("string"))
    decided = placed.filter(F.col("event").isin(*DECISIONS)).groupBy("run_id", "_segment").agg(F.min(at).alias("_first"))
    joined = placed.join(decided, ["run_id", "_segment"], "left")
    awaits = F.coalesce(F.col("_since") == "awaiting", F.col("_prior") == SETS["awaiting"], F.lit(False))
    legal = sets | (awaits & (at == F.col("_first")))
    mapping = F.create_map(*[F.lit(x) for pair in {**SETS, **DECISIONS}.items() for x in pair])
    return joined.withColumn("legal", legal).select(
        "run_id", "ts", "seq", "event", "legal", F.when(F.col("legal"), mapping[F.col("event")]).alias("status")
    )


def latest(judged: DataFrame) -> DataFrame:
    """Status per run after the judged events; queued where nothing legal happened."""
    return _standing(judged).select("run_id", F.coalesce("status", F.lit("queued")).alias("status"), "rejected_events")


def _standing(judged: DataFrame) -> DataFrame:
    last = F.max(F.when(F.col("legal"), F.struct("ts", "seq", "status")))
    return judged.groupBy("run_id").agg(last.alias("_last"), F.count_if(~F.col("legal")).alias("rejected_events")).select(
        "run_id", "_last.status", "rejected_events", "_last.ts", "_last.seq"
    )


def advanced(judged: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (run_id, status, rejected_events, ts, seq) after the judged events of a batch.

    An event changes the status only when it is newer, by (ts, seq), than the one that set it; a late event of an
    earlier time is judged and counted, but doesn't turn the status back.
    """
    both = state.select("run_id", F.nullif("status", F.lit("queued")).alias("status"), "rejected_events", "ts", "seq").unionByName(_standing(judged))
    set_by = F.max(F.when(F.col("status").isNotNull(), F.struct("ts", "seq", "status")))
    return both.groupBy("run_id").agg(set_by.alias("_last"), F.sum("rejected_events").alias("rejected_events")).select(
        "run_id", F.coalesce("_last.status", F.lit("queued")).alias("status"), "rejected_events", "_last.ts", "_last.seq"
    )
