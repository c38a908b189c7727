"""Progress and run status as streams with durable status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chunkloom.operators import progress, runs
from chunkloom.schemas import PROGRESS
from chunkloom.streaming.deliveries import each_batch
from chunkloom.streaming.state import BatchState

RUN_STATE = "run_id string, status string, rejected_events long, ts timestamp, seq long"


def write_status(stream: DataFrame, state_root: str, checkpoint: str, available_now: bool = True):
    """Keep the reduced progress events of every repository; read them back with :func:`status`."""
    spark = stream.sparkSession
    state = BatchState(spark, state_root, PROGRESS)
    columns = ["repository_id", "ts", "event", "data"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        merged = state.read(before=batch_id).unionByName(batch.select(*columns))
        state.write(progress.reduce_events(merged).select(*columns), batch_id)

    return each_batch(stream, handle, checkpoint, available_now)


def status(spark, state_root: str) -> DataFrame:
    return progress.fold(BatchState(spark, state_root, PROGRESS).read())


def write_run_status(stream: DataFrame, state_root: str, checkpoint: str, rejected_root: str | None = None, available_now: bool = True):
    """Fold run events into a status per run; illegal events go to ``rejected_root``, one folder a batch."""
    spark = stream.sparkSession
    state = BatchState(spark, state_root, RUN_STATE)

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = state.read(before=batch_id)
        judged = runs.judge(batch, before)
        if rejected_root:
            judged.filter("NOT legal").write.mode("overwrite").parquet(f"{rejected_root}/batch={batch_id}")
        state.write(runs.advanced(judged, before), batch_id)

    return each_batch(stream, handle, checkpoint, available_now)


def run_status(spark, state_root: str) -> DataFrame:
    return BatchState(spark, state_root, RUN_STATE).read().select("run_id", "status", "rejected_events")
