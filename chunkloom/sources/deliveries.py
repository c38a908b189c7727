"""Delivery rows, as a batch or a stream of JSON files (the body base64, kept as raw bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.schemas import DELIVERIES


def read_deliveries(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of deliveries from files as they arrive."""
    reader = spark.readStream.schema(DELIVERIES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def read_delivery_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELIVERIES).json(path)
