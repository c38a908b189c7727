"""Embeddings: a deterministic provider and the embed-only-what-is-new join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from chunkloom.operators.skew import spread_join
from chunkloom.schemas import EMBEDDING_DIMS


def hash_seeded_vector(text: str, dims: int) -> np.ndarray:
    """Unit vector drawn from a Mersenne Twister seeded by the first 8 bytes of SHA-256."""
    seed = int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest()[:8], "big")
    words = [seed & 0xFFFFFFFF] + ([seed >> 32] if seed >> 32 else [])
    vector = np.random.RandomState(words).random_sample(dims) * 2.0 - 1.0
    norm = float(np.sqrt(np.dot(vector, vector)))
    return vector / norm if norm else vector


def deterministic(dims: int = EMBEDDING_DIMS) -> Callable[[Column], Column]:
    """Embedding function over a text column (Arrow batches)."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_seeded_vector(t, dims).astype(np.float32))

    return embed


def embed_new(
    chunks: DataFrame, vectors: DataFrame | None, embed: Callable[[Column], Column]
) -> DataFrame:
    """Vectors for ``chunks``; each distinct content is embedded once, known content not at all.

    Rows of (chunk_id, repository_id, content_hash, embedding). Copies are collapsed by a grouped
    aggregate before the embedding function runs, and spread when joined back.
    """
    contents = chunks.groupBy("content_hash").agg(F.any_value("content").alias("content"))
    known = None
    if vectors is not None:
        stored = vectors.groupBy("content_hash").agg(F.any_value("embedding").alias("embedding"))
        known = stored.join(contents.select("content_hash"), "content_hash", "left_semi")
        contents = contents.join(stored.select("content_hash"), "content_hash", "left_anti")
    fresh = contents.select("content_hash", embed(F.col("content")).alias("embedding"))
    lookup = fresh if known is None else fresh.unionByName(known)
    return spread_join(
        chunks.select("chunk_id", "repository_id", "content_hash"), lookup, ["content_hash"], "chunk_id"
    ).select("chunk_id", "repository_id", "content_hash", "embedding")
