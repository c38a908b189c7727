"""Session settings, reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Upper bound for anything this library broadcasts by hint.
BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app: str = "chunkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew-join handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """Small local session for tests and the benchmark script."""
    cpus = cpus or os.cpu_count() or 4
    return build_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("CHUNKLOOM_DRIVER_MEMORY", "8g"),
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            **conf,
        },
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables: the cluster's own setting when there is one.

    Only a local session without ``spark.checkpoint.dir`` (a test on one machine) gets a temporary folder; on a
    cluster a folder of the driver's machine would be out of the executors' reach, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    created = tempfile.mkdtemp(prefix="chunkloom-")
    spark.sparkContext.setCheckpointDir(created)
    return created


def spread(df: DataFrame, bytes_per_core: int = 16 * 1024 * 1024) -> DataFrame:
    """Use every core for a small input that was read as few partitions; a large one is left alone.

    The size is the optimizer's estimate, so nothing runs. Meant before row-wise heavy work, where a
    single small file would otherwise be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_core else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so several consumers share the work.

    A table instead of an RDD checkpoint: it is computed once, is columnar, and later reads prune
    columns and push filters. It survives the loss of any executor. Old tables are removed by
    whoever owns the folder.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType):
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 32
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of ``df`` by one aggregate over its columns (never a collect)."""
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(field.name, field.dataType)
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the measured size is under ``limit``; else leave the shuffle join."""
    return F.broadcast(df) if is_small(df, limit) else df
