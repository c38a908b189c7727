"""Hybrid search and extractive answers for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.functions.content import label
from chunkloom.operators import bm25, dense, fusion, ivf, rerank
from chunkloom.operators.search import check_top_k, validate_queries
from chunkloom.schemas import BM25_CANDIDATES, CHAT_TOP_K, DEFAULT_TOP_K, DENSE_CANDIDATES
from chunkloom.session import cut

HIT_FIELDS = ["file_path", "language", "symbol", "kind", "start_line", "end_line", "content"]


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, top_k: int = DEFAULT_TOP_K,
    scorer: Callable[[Column, Column], Column] | None = None, index: bm25.Bm25Index | None = None,
    approximate: bool = False, dense_candidates: int | None = DENSE_CANDIDATES, lexical_candidates: int | None = BM25_CANDIDATES,
    lists: ivf.IvfIndex | None = None,
) -> DataFrame:
    """Dense and BM25 candidates, fused by reciprocal rank, joined to chunks, reranked and cut.

    ``queries``: repository_id, query_id, query, embedding. The order is by fused score; the
    reported ``score`` is the cosine where the chunk was a dense hit, else the fused value. A
    ``top_k`` column in ``queries`` overrides the argument per query. ``dense_candidates`` and ``lexical_candidates`` are
    how many of each list are fused, all with None; results beyond their sum need larger ones. ``lists`` is an inverted
    file of ``vectors`` that is searched in place of them.
    """
    check_top_k(top_k)
    asked = validate_queries(queries)
    if "top_k" not in asked.columns:
        asked = asked.withColumn("top_k", F.lit(top_k))
    if lists is not None:
        near = ivf.search(asked, lists, dense_candidates)
    else:
        near = (dense.knn_lsh if approximate else dense.knn)(asked, vectors, dense_candidates)
    lexical = bm25.search(asked, chunks, lexical_candidates, index)
    key = ["repository_id", "query_id", "chunk_id"]
    merged = near.select(
        *key, F.lit(0).alias("_list"), "rank", F.col("dense_score").alias("_value")
    ).unionByName(lexical.select(*key, F.lit(1).alias("_list"), "rank", F.col("bm25_score").alias("_value")))
    of = lambda i, c: F.max(F.when(F.col("_list") == i, F.col(c)))
    fused = merged.groupBy(*key).agg(
        F.round(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))), 12).alias("fused_score"),
        of(0, "_value").alias("dense_score"), of(1, "_value").alias("bm25_score"),
        of(0, "rank").alias("dense_rank"), of(1, "rank").alias("bm25_rank"),
    )
    # Stored once, so that the join with the chunk texts is planned by the true size of the hits.
    fused = cut(fused)
    hits = chunks.select("repository_id", "chunk_id", *HIT_FIELDS).join(
        fused, ["repository_id", "chunk_id"]
    ).join(asked.select("repository_id", "query_id", "query", "top_k"), ["repository_id", "query_id"])
    hits = hits.withColumn("score", F.coalesce("dense_score", "fused_score"))
    ranked = rerank.apply(hits, scorer)
    order = Window.partitionBy("repository_id", "query_id").orderBy(
        F.desc_nulls_last("rerank_score"), F.desc("fused_score"), F.asc_nulls_last("dense_rank"), F.asc("bm25_rank"), "chunk_id"
    )
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("top_k"))
        .select(
            "repository_id", "query_id", "query", "rank", "chunk_id", *HIT_FIELDS,
            "score", "dense_score", "bm25_score", "fused_score",
        )
    )


def quoted(text: str | Column) -> Column:
    """Text in the quotes of the answer template: double only when it holds single quotes alone."""
    t = F.col(text) if isinstance(text, str) else text
    escaped = F.replace(F.replace(F.replace(F.replace(
        t, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.when(t.contains("'") & ~t.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def extractive(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One answer per query from its ranked hits (at most 50 a query): a header and one line per hit."""
    line = F.concat(
        F.lit("- "), label("symbol", "kind"), F.lit(" ("), F.col("kind"), F.lit(") in "),
        F.format_string("%s:%d-%d", F.col("file_path"), F.col("start_line"), F.col("end_line")),
    )
    collected = hits.groupBy("repository_id", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_rows")
    )
    n = F.size("_rows")
    found = F.concat(
        F.lit("Found "), n.cast("string"), F.lit(" relevant location(s) for: "), quoted("query"), F.lit("\n\n"),
        F.array_join(F.transform("_rows", lambda r: r["line"]), "\n"),
    )
    none = F.concat(F.lit("No relevant code was found for: "), quoted("query"))
    return queries.select("repository_id", "query_id", "query").join(
        collected, ["repository_id", "query_id"], "left"
    ).select(
        "repository_id", "query_id",
        F.when(F.col("_rows").isNull(), 0).otherwise(n).alias("n_hits"),
        F.when(F.col("_rows").isNull(), none).otherwise(found).alias("answer"),
    )


def answer(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Answers and the hits they cite."""
    hits = hybrid_search(queries, chunks, vectors, top_k=CHAT_TOP_K, **options)
    return extractive(queries, hits), hits
