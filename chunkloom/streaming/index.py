"""Incremental indexing driven by a delivery stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.operators import deliveries as ops
from chunkloom.plans.index import Corpus, diff_of, incremental_index
from chunkloom.schemas import CHUNKS, INDEXED_FILES
from chunkloom.session import cut
from chunkloom.sources.tables import TableStore
from chunkloom.streaming.deliveries import each_batch
from chunkloom.streaming.state import BatchNumbers, BatchState, stored

INDEX_STATE = "repository_id string, last_indexed_commit string"
STORED = "delivery_id string, event_type string, received_at timestamp, repository_id string, outcome string, status string"
TABLES = {"files": INDEXED_FILES, "chunks": CHUNKS}


def store_of(spark, root: str) -> TableStore:
    return TableStore(spark, f"{root}/tables", TABLES)


def apply_pushes(
    pushes: DataFrame, snapshots: Callable[[DataFrame], DataFrame], store: TableStore, state: BatchState, batch_id: int,
    embed: Callable[[Column], Column] | None = None,
) -> None:
    """Bring the pushed repositories to their newest commit.

    ``pushes``: repository_id, after. ``snapshots`` gives the files of (repository_id, after) rows. The
    base is the stored commit: an equal commit is a no-op, a repository without one is indexed in
    full. Only the buckets of the pushed repositories are read and rewritten.
    """
    before = state.read(before=batch_id)
    wanted = cut(
        pushes.join(before, "repository_id", "left")
        .filter(F.col("last_indexed_commit").isNull() | (F.col("last_indexed_commit") != F.col("after")))
        .select("repository_id", "after")
    )
    buckets = store.touched_buckets(wanted)
    version = batch_id + 1
    if buckets and (store.version() or 0) < version:
        files = snapshots(wanted)
        in_scope = lambda df: df.join(wanted.select("repository_id"), "repository_id", "left_semi")
        current = Corpus(store.read("files", buckets=buckets), store.read("chunks", buckets=buckets))
        prior = Corpus(in_scope(current.files), in_scope(current.chunks))
        # A repository without a stored commit has no prior files, so its diff adds every file.
        result = incremental_index(diff_of(prior.files, files), files, prior, embed).corpus
        out_of_scope = lambda df: df.join(wanted.select("repository_id"), "repository_id", "left_anti")
        chunk_columns = [c.split()[0] for c in CHUNKS.split(", ")]
        file_columns = [c.split()[0] for c in INDEXED_FILES.split(", ")]
        store.commit(
            version,
            {
                "files": result.files.unionByName(out_of_scope(current.files)).select(*file_columns),
                "chunks": result.chunks.unionByName(out_of_scope(current.chunks)).select(*chunk_columns),
            },
            touched=buckets,
        )
    after = wanted.select("repository_id", F.col("after").alias("last_indexed_commit"))
    state.write(before.join(after, "repository_id", "left_anti").unionByName(after), batch_id)


def ingest(
    stream: DataFrame, secret: str, repositories: DataFrame, root: str, checkpoint: str,
    snapshots: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
):
    """Deliveries to stored outcomes, backfilled repositories and, with ``snapshots``, an updated index.

    Per batch: gate against all stored ids, append the accepted and the rejected rows, keep the
    repository table, apply the newest queued push of each repository.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in repositories.schema.fields)
    known = BatchState(spark, f"{root}/repositories", schema)
    index_state = BatchState(spark, f"{root}/index_state", INDEX_STATE)
    store = store_of(spark, root)

    numbers = BatchNumbers(spark, root, known.batches)

    def earlier(before: int) -> DataFrame:
        if not stored(spark, f"{root}/deliveries"):
            return spark.createDataFrame([], STORED)
        rows = spark.read.schema(STORED + ", batch long").parquet(f"{root}/deliveries")
        return rows.filter(F.col("batch") < before).drop("batch")

    def handle(batch: DataFrame, stream_batch: int) -> None:
        batch_id = numbers.number(stream_batch, checkpoint)
        repos = known.read(before=batch_id)
        repos = repositories if repos.isEmpty() else repos
        accepted, rejected = ops.gate(batch, secret, repos, earlier(batch_id))
        accepted = cut(accepted)
        columns = [c.split()[0] for c in STORED.split(", ")]
        accepted.select(*columns).write.mode("overwrite").parquet(f"{root}/deliveries/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
        known.write(ops.backfill(repos, accepted), batch_id)
        if snapshots is not None:
            apply_pushes(ops.newest_push(accepted), snapshots, store, index_state, batch_id)

    return each_batch(stream, handle, checkpoint, available_now)
