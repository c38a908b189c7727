"""Streaming forms of the delivery operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom.operators import deliveries as ops


def dedup(stream: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Drop repeated delivery ids that arrive within ``horizon`` of the first.

    State is bounded by the watermark; for ids that must be known forever, :func:`ingest` leaves
    out the stored ones in every batch.
    """
    return stream.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(["delivery_id"])


def outcomes(stream: DataFrame, repositories: DataFrame) -> DataFrame:
    """Outcome of each push by stream-static joins."""
    return ops.outcomes(ops.match_repository(stream, repositories))


def hourly(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Deliveries per hour and status; rows later than ``lateness`` are dropped."""
    return ops.hourly(stream.withWatermark("received_at", lateness))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def each_batch(stream: DataFrame, handle, checkpoint: str, available_now: bool = True):
    """``foreachBatch`` with a durable offset log; ``handle(batch, batch_id)`` must be idempotent per id."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
