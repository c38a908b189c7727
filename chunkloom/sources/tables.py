"""Versioned Parquet tables, partitioned by repository bucket.

A table lives at ``root/name/version=N/repository_bucket=B``. A commit writes only the buckets it
touched and then one small manifest that says which version holds each bucket, so readers see
either the state before or the state after, and unchanged buckets are never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BUCKETS = 256


def bucket_of(repository_id: str = "repository_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repository_id), F.lit(buckets)).cast("int")


class TableStore:
    """Snapshot store for a fixed set of tables that all carry ``repository_id``."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.buckets = spark, root.rstrip("/"), schemas, buckets

    def _manifests(self) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.schema("table string, bucket int, data_version long, version long").parquet(
            f"{self.root}/_manifest"
        )

    def version(self) -> int | None:
        """Latest committed version, null for an empty store."""
        manifests = self._manifests()
        return None if manifests is None else manifests.agg(F.max("version")).first()[0]

    def _live(self) -> list:
        latest = self.version()
        if latest is None:
            return []
        return self._manifests().filter(F.col("version") == latest).collect()  # ≤ tables × buckets rows

    def read(
        self, table: str, repository_ids: list[str] | None = None, buckets: list[int] | None = None
    ) -> DataFrame:
        """Current rows; with ids or buckets, only those buckets are listed and ids reach the scan."""
        wanted = None if buckets is None else set(buckets)
        if repository_ids is not None:
            ids = self.spark.createDataFrame([(r,) for r in repository_ids], "repository_id string")
            wanted = {r[0] for r in ids.select(bucket_of(buckets=self.buckets)).distinct().collect()}
        paths = [
            f"{self.root}/{table}/version={r['data_version']}/repository_bucket={r['bucket']}"
            for r in self._live()
            if r["table"] == table and (wanted is None or r["bucket"] in wanted)
        ]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        rows = self.spark.read.schema(self.schemas[table]).parquet(*paths)
        if repository_ids is not None:
            rows = rows.filter(F.col("repository_id").isin(repository_ids))
        return rows

    def commit(self, version: int, tables: dict[str, DataFrame], touched: list[int] | None = None) -> None:
        """Write the touched buckets of each table as ``version`` and publish the manifest.

        ``tables`` hold the full new content of the touched buckets (all buckets when None). The
        rebalance hint lets adaptive execution split a bucket that holds a large repository.
        """
        live = {(r["table"], r["bucket"]): r["data_version"] for r in self._live()}
        for name, df in tables.items():
            rows = df.withColumn("repository_bucket", bucket_of(buckets=self.buckets))
            if touched is not None:
                rows = rows.filter(F.col("repository_bucket").isin(touched))
            path = f"{self.root}/{name}/version={version}"
            rows.hint("rebalance", "repository_bucket").write.mode("overwrite").partitionBy(
                "repository_bucket"
            ).parquet(path)
            written = {
                r[0]
                for r in self.spark.read.schema(self.schemas[name] + ", repository_bucket int").parquet(path)
                .select("repository_bucket").distinct().collect()
            }
            gone = range(self.buckets) if touched is None else touched
            for bucket in gone:
                live.pop((name, bucket), None)
            live.update({(name, bucket): version for bucket in written})
        rows = [(t, b, v, version) for (t, b), v in live.items()] or [("", -1, -1, version)]
        self.spark.createDataFrame(
            rows, "table string, bucket int, data_version long, version long"
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def touched_buckets(self, repositories: DataFrame) -> list[int]:
        """Buckets of the given repositories; at most ``buckets`` rows reach the driver."""
        return [r[0] for r in repositories.select(bucket_of(buckets=self.buckets)).distinct().collect()]


def merge_snapshot(
    current: DataFrame, upserts: DataFrame, deletes: DataFrame, patches: DataFrame | None = None, key: str = "chunk_id"
) -> DataFrame:
    """Upsert, delete and patch rows by key, as joins.

    ``patches`` has the key plus the columns to overwrite; a null there leaves the row as it is.
    """
    gone = upserts.select(key).unionByName(deletes.select(key)).distinct()
    kept = current.join(gone, key, "left_anti")
    if patches is not None:
        fields = [c for c in patches.columns if c != key]
        renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
        kept = kept.join(renamed, key, "left")
        for c in fields:
            kept = kept.withColumn(c, F.coalesce(f"_new_{c}", c))
        kept = kept.select(*current.columns)
    return kept.unionByName(upserts.select(*current.columns))


def drop_repository(df: DataFrame, repository_ids: DataFrame) -> DataFrame:
    return df.join(repository_ids.select("repository_id").distinct(), "repository_id", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], repository_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove repositories from every table that carries ``repository_id``."""
    ids = repository_ids.select("repository_id").distinct()
    return {name: df.join(ids, "repository_id", "left_anti") for name, df in tables.items()}


def scope(df: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows of the given repositories only."""
    return df.join(repositories.select("repository_id").distinct(), "repository_id", "left_semi")
