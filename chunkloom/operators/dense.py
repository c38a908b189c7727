"""Dense retrieval: exact and approximate cosine kNN for many queries over many repositories.

Scoring is a matrix product per block of vectors and queries inside a task; only the best ``k`` rows
per query and block leave the task, so the pairs themselves are never rows of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType, DoubleType

from chunkloom.schemas import DENSE_CANDIDATES
from chunkloom.session import BROADCAST_BYTES, is_small, sized_broadcast

VECTORS_PER_CELL = 50_000
QUERIES_PER_CELL = 2_000


def check_dims(df: DataFrame, column: str = "embedding") -> int:
    """Dimension of a collection; raises when vectors of several lengths are mixed."""
    row = df.agg(F.count_distinct(F.size(column)).alias("n"), F.max(F.size(column)).alias("dims")).first()
    if row["n"] > 1:
        raise ValueError(f"vectors of {row['n']} different dimensions in one collection")
    return row["dims"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a list column as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int | None) -> np.ndarray:
    """Column positions of the k best scores per row set, ties by id; all without ``k``."""
    if k is None or scores.shape[0] <= k:
        return np.arange(scores.shape[0])
    kth = np.partition(scores, -k)[-k]
    keep = np.flatnonzero(scores >= kth)
    if len(keep) > k:
        order = np.lexsort((ids[keep], -scores[keep]))
        keep = keep[order[:k]]
    return keep


def _score_block(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """Per query row: positions of queries, positions of vectors, scores (rounded so ties are exact)."""
    scores = np.round(q @ v.T, 12)
    qs, vs, out = [], [], []
    for row in range(scores.shape[0]):
        keep = _best(scores[row], ids, k)
        qs.append(np.full(len(keep), row))
        vs.append(keep)
        out.append(scores[row][keep])
    return qs, vs, out


def _output_schema(queries: DataFrame, vectors: DataFrame) -> StructType:
    return StructType([
        queries.schema["repository_id"], queries.schema["query_id"], vectors.schema["chunk_id"],
        StructField("dense_score", DoubleType()),
    ])


def _scan_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Small query batch: send the queries to every task, read the vectors once, shuffle only hits."""
    spark = queries.sparkSession
    table = queries.select("repository_id", "query_id", "embedding").toArrow()
    blocks = {}
    for repository in set(table.column("repository_id").to_pylist()):
        part = table.filter(pa.compute.equal(table.column("repository_id"), repository))
        blocks[repository] = (part.column("query_id").combine_chunks(), _matrix(part.column("embedding")))
    shared = spark.sparkContext.broadcast(blocks)
    schema = _output_schema(queries, vectors)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        types = None
        for batch in batches:
            types = (batch.schema.field("repository_id").type, batch.schema.field("chunk_id").type)
            encoded = batch.column("repository_id").dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            ids = batch.column("chunk_id")
            for code, repository in enumerate(encoded.dictionary.to_pylist()):
                if repository not in shared.value:
                    continue
                where = np.flatnonzero(codes == code)
                part = batch.take(pa.array(where))
                _, q = shared.value[repository]
                part_ids = part.column("chunk_id").to_numpy(zero_copy_only=False)
                qs, vs, out = _score_block(q, _matrix(part.column("embedding")), part_ids, k)
                best = held.setdefault(repository, [[None, None] for _ in range(len(q))])
                for row in range(len(q)):
                    ids_now, scores_now = part_ids[vs[row]], out[row]
                    if best[row][0] is not None:
                        ids_now = np.concatenate([best[row][0], ids_now])
                        scores_now = np.concatenate([best[row][1], scores_now])
                        keep = _best(scores_now, ids_now, k)
                        ids_now, scores_now = ids_now[keep], scores_now[keep]
                    best[row] = [ids_now, scores_now]
        for repository, best in held.items():
            query_ids, _ = shared.value[repository]
            counts = [len(b[0]) for b in best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([repository] * sum(counts), types[0]),
                    query_ids.take(pa.array(np.repeat(np.arange(len(best)), counts))),
                    pa.array(np.concatenate([b[0] for b in best]), types[1]),
                    pa.array(np.concatenate([b[1] for b in best])),
                ],
                names=schema.names,
            )

    wanted = vectors.select("repository_id", "chunk_id", "embedding")
    return wanted.mapInArrow(score, schema)


def _grid_topk(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Any number of queries: split every key group into cells of bounded size and score cell by cell.

    A group of V vectors and Q queries becomes ceil(V / 50000) x ceil(Q / 2000) cells; a vector goes
    to one cell per query block and a query to one cell per vector block, so a key that holds most
    rows is spread over many tasks and no task holds more than one cell.
    """
    n_v = vectors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / VECTORS_PER_CELL).cast("int").alias("_nv"))
    n_q = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_CELL).cast("int").alias("_nq"))
    grid = sized_broadcast(n_v.join(n_q, keys))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = [c for c in ("repository_id",) if c not in keys]
    v = (
        vectors.select(*keys, "chunk_id", "embedding").join(grid, keys)
        .withColumn("_v", part("chunk_id", "_nv")).withColumn("_q", every("_nq")).drop("_nv", "_nq")
    )
    q = (
        queries.select(*keys, *carried, "query_id", "embedding").join(grid, keys)
        .withColumn("_q", part("query_id", "_nq")).withColumn("_v", every("_nv")).drop("_nv", "_nq")
    )
    schema = _output_schema(queries, vectors)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = [left.schema.field("repository_id").type, left.schema.field("query_id").type,
                 right.schema.field("chunk_id").type, pa.float64()]
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table([pa.array([], t) for t in empty], names=schema.names)
        ids = right.column("chunk_id").combine_chunks()
        qs, vs, out = _score_block(
            _matrix(left.column("embedding")), _matrix(right.column("embedding")),
            ids.to_numpy(zero_copy_only=False), k,
        )
        rows = pa.array(np.concatenate(qs))
        return pa.table(
            [
                left.column("repository_id").combine_chunks().take(rows),
                left.column("query_id").combine_chunks().take(rows),
                ids.take(pa.array(np.concatenate(vs))),
                pa.array(np.concatenate(out)),
            ],
            names=schema.names,
        )

    cell = [*keys, "_q", "_v"]
    return q.groupBy(*cell).cogroup(v.groupBy(*cell)).applyInArrow(score, schema)


def _top(hits: DataFrame, k: int | None) -> DataFrame:
    best = Window.partitionBy("repository_id", "query_id").orderBy(F.desc("dense_score"), "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def knn(
    queries: DataFrame, vectors: DataFrame, k: int | None = DENSE_CANDIDATES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Exact top ``k`` by cosine inside the query's repository; None ranks all its vectors.

    ``queries``: repository_id, query_id, embedding; ``vectors``: repository_id, chunk_id, embedding.
    A query batch that measures under ``broadcast_bytes`` goes to the vectors; a larger one is met
    in the cell grid, and so is a search without ``k``, as a task would hold all its hits. Both give the same rows.
    """
    asked = queries.select("repository_id", "query_id", "embedding")
    if k is not None and is_small(asked, broadcast_bytes):
        return _top(_scan_topk(asked, vectors, k), k)
    return _top(_grid_topk(asked, vectors, ["repository_id"], k), k)


def knn_lsh(
    queries: DataFrame, vectors: DataFrame, k: int | None = DENSE_CANDIDATES,
    tables: int = 16, bucket_length: float = 0.5, seed: int = 7,
) -> DataFrame:
    """Approximate top ``k``: random-projection buckets give candidates, exact cosine ranks them.

    Recall grows with ``tables`` and ``bucket_length``. Buckets are scored in the same cell grid as
    the exact search, so an overfull bucket is split over tasks rather than truncated.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(df: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return df.withColumn("_norm", norm).withColumn(
            "_unit",
            array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0))),
        ).drop("_norm")

    lsh = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    model = lsh.fit(unit(vectors.select("embedding")))

    def bucketed(df: DataFrame, row_id: str) -> DataFrame:
        return (
            model.transform(unit(df.select("repository_id", row_id, "embedding")))
            .select("repository_id", row_id, "embedding", F.posexplode("_hashes").alias("band", "_value"))
            .withColumn("bucket", vector_to_array("_value")[0].cast("long")).drop("_value")
        )

    hits = _grid_topk(bucketed(queries, "query_id"), bucketed(vectors, "chunk_id"), ["repository_id", "band", "bucket"], k)
    return _top(hits.groupBy("repository_id", "query_id", "chunk_id").agg(F.max("dense_score").alias("dense_score")), k)
