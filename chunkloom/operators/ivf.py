"""Approximate dense retrieval by an inverted file: coarse centroids, lists of vectors, probes, exact re-scoring.

1. ``build`` clusters a bounded sample of unit vectors (``SAMPLE_PER_LIST`` a list, chosen by the hash of their ids) by
   spherical k-means. The centroids are one small matrix, held under ``BROADCAST_BYTES`` by the number of lists.
2. Every vector goes to the list of its nearest centroid; the lists are one stored table.
3. How many lists a query must probe is measured, not guessed: the exact neighbours of up to ``TUNING_QUERIES`` queries
   are found, and the probes are the least number that holds the wanted share of them (``target``).
4. A search joins each query with its nearest lists and scores the vectors of these lists exactly, in cells of bounded
   size, so a list with a third of all vectors is many tasks and no list is cut. Vectors of lists that nobody probes
   are dropped where they are read.

How much work is saved depends on the data: vectors in clusters need few probes, vectors without structure many.
Empty and all-zero vectors have no direction and score 0 against everything; null vectors are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from chunkloom.operators.dense import _grid_topk, _matrix, _top, check_dims, knn
from chunkloom.schemas import DENSE_CANDIDATES
from chunkloom.session import BROADCAST_BYTES, cut

SAMPLE_PER_LIST = 64
TUNING_QUERIES = 200
TARGET = 0.95
ROUNDS = 10


@dataclass
class IvfIndex:
    """centroids: unit rows, one a list; lists(repository_id, chunk_id, embedding, list), stored; probes: lists a query reads."""

    centroids: np.ndarray
    lists: DataFrame
    probes: int


def _usable(vectors: DataFrame, row_id: str) -> DataFrame:
    return vectors.filter("embedding IS NOT NULL AND size(embedding) > 0").select("repository_id", row_id, "embedding")


def list_count(n: int, dims: int) -> int:
    """About the square root of the number of vectors, as far as the centroids stay a small broadcast."""
    return max(1, min(round(math.sqrt(n)), BROADCAST_BYTES // (8 * max(dims, 1))))


def _by_hash(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """``n`` rows that depend on their ids only, whatever the partitions."""
    return df.orderBy(F.xxhash64(row_id), row_id).limit(n)


def train(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Spherical k-means over unit rows; a list that loses all its rows takes the row that fits its own list worst."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        scores = sample @ centroids.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        worst = np.argsort(scores[np.arange(len(sample)), nearest], kind="stable")
        sums[empty] = sample[worst[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.divide(sums, norms, out=centroids.copy(), where=norms > 0)
    return centroids


def _near_lists(df: DataFrame, row_id: str, centroids: np.ndarray, n: int, column: StructField) -> DataFrame:
    """``df`` with its ``n`` nearest lists, nearest first; ties go to the smaller list."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    plain = isinstance(column.dataType, IntegerType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores = np.round(_matrix(batch.column("embedding")) @ shared.value.T, 12)
            if plain:
                found = pa.array(scores.argmax(axis=1).astype(np.int32))
            else:
                order = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, column.name])

    narrow = df.select("repository_id", row_id, "embedding")
    return narrow.mapInArrow(run, StructType([*narrow.schema.fields, column]))


def assign(vectors: DataFrame, centroids: np.ndarray, row_id: str = "chunk_id") -> DataFrame:
    """(repository_id, row_id, embedding, list): each vector with its nearest list."""
    return _near_lists(vectors, row_id, centroids, 1, StructField("list", IntegerType()))


def probe(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(repository_id, query_id, embedding, place, list): a row for each of the ``probes`` nearest lists, place from 1."""
    if not centroids.size:
        return queries.select("repository_id", "query_id", "embedding", F.lit(1).alias("place"), F.lit(0).alias("list"))
    n = min(probes, len(centroids))
    near = _near_lists(queries, "query_id", centroids, n, StructField("near", ArrayType(IntegerType())))
    return near.select("repository_id", "query_id", "embedding", F.posexplode("near").alias("place", "list")).withColumn("place", F.col("place") + 1)


def tune(queries: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int, target: float) -> int:
    """Least number of probes whose lists hold a share of ``target`` of the exact ``k`` neighbours of all ``queries``."""
    exact = knn(queries, lists, k).select("repository_id", "query_id", "chunk_id")
    at = exact.join(lists.select("repository_id", "chunk_id", "list"), ["repository_id", "chunk_id"])
    order = probe(queries, centroids, len(centroids)).select("repository_id", "query_id", "list", "place")
    placed = at.join(order, ["repository_id", "query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    # One row a list at most, so the running sum is over a bounded table.
    running = Window.orderBy("place")
    share = F.sum("n").over(running) / F.sum("n").over(Window.partitionBy())
    row = placed.withColumn("share", share).filter(F.col("share") >= target - 1e-12).agg(F.min("place")).first()
    return int(row[0] or 1)


def build(
    vectors: DataFrame, queries: DataFrame | None = None, lists: int | None = None, k: int = DENSE_CANDIDATES,
    target: float = TARGET, probes: int | None = None,
) -> IvfIndex:
    """Index of all ``vectors`` (repository_id, chunk_id, embedding).

    ``queries`` (repository_id, query_id, embedding) are what the probes are tuned on, at most ``TUNING_QUERIES`` of
    them by the hash of their ids; without them the vectors themselves are. ``probes`` given, nothing is tuned. An
    index of no vectors answers every query with no row.
    """
    usable = _usable(vectors, "chunk_id")
    size = usable.count()
    if size == 0:
        empty = cut(usable.limit(0).withColumn("list", F.lit(0)))
        return IvfIndex(np.zeros((1, 0)), empty, 1)
    dims = check_dims(usable)
    wanted = lists or list_count(size, dims)
    rows = _by_hash(usable, "chunk_id", wanted * SAMPLE_PER_LIST).select("embedding").toArrow()
    centroids = train(_matrix(rows.column("embedding")), wanted)
    # Rows of a list lie together, so a search that reads few lists skips row groups.
    stored = cut(assign(usable, centroids).sortWithinPartitions("list"))
    if probes is None:
        asked = _usable(queries, "query_id") if queries is not None else usable.withColumnRenamed("chunk_id", "query_id")
        probes = tune(cut(_by_hash(asked, "query_id", TUNING_QUERIES)), stored, centroids, k, target)
    return IvfIndex(centroids, stored, probes)


def search(queries: DataFrame, index: IvfIndex, k: int | None = DENSE_CANDIDATES, probes: int | None = None) -> DataFrame:
    """Top ``k`` by exact cosine among the vectors of the probed lists, in the query's repository; None keeps all of them."""
    asked = cut(probe(_usable(queries, "query_id"), index.centroids, probes or index.probes).drop("place"))
    return _top(_grid_topk(asked, index.lists, ["repository_id", "list"], k), k)


def scored_pairs(queries: DataFrame, index: IvfIndex, probes: int | None = None) -> DataFrame:
    """(repository_id, query_id, scored, pairs): vectors that a search scores for a query, of all in its repository."""
    sizes = index.lists.groupBy("repository_id", "list").agg(F.count(F.lit(1)).alias("n"))
    all_ = sizes.groupBy("repository_id").agg(F.sum("n").alias("pairs"))
    met = probe(_usable(queries, "query_id"), index.centroids, probes or index.probes).drop("embedding").join(sizes, ["repository_id", "list"], "left")
    return (
        met.groupBy("repository_id", "query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
        .join(all_, "repository_id", "left").select("repository_id", "query_id", "scored", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    )
