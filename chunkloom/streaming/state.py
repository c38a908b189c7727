"""Small durable state for ``foreachBatch`` jobs: one Parquet folder per batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stored(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at ``path``; other errors of the file system are raised."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


class BatchNumbers:
    """Numbers of batches that go on growing when a stream starts again with a new checkpoint.

    A stream's id lives in its checkpoint. The first batch of an id gets the number after all that ``used`` tells,
    and that base is stored, so a batch that is run again after a failure has the number it had.
    """

    def __init__(self, spark: SparkSession, root: str, used):
        self.spark, self.path, self.used = spark, f"{root.rstrip('/')}/streams", used

    def number(self, batch_id: int, checkpoint: str) -> int:
        stream = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if stored(self.spark, self.path):
            base = self.spark.read.parquet(self.path).filter(F.col("stream") == stream).agg(F.max("base")).first()[0]
            if base is not None:
                return base + batch_id
        base = max(self.used(), default=-1) + 1 - batch_id
        self.spark.createDataFrame([(stream, base)], "stream string, base long").coalesce(1).write.mode("append").parquet(self.path)
        return base + batch_id


class BatchState:
    """State written per batch under ``root/batch=N``.

    A batch reads the newest state below its own id and writes its own, so a batch that is run again
    after a failure starts from the same state and overwrites the same folder.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = []
        for entry in fs.listStatus(path):
            name = entry.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
            if name.startswith("batch=") and fs.exists(marker):
                done.append(int(name.split("=")[1]))
        return done

    def read(self, before: int | None = None) -> DataFrame:
        known = [b for b in self.batches() if before is None or b < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/batch={max(known)}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
