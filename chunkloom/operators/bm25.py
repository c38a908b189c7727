"""BM25 over chunk corpora, statistics per repository.

Constants: k1 = 1.5, b = 0.75; idf = ln((N - df + 0.5) / (df + 0.5)), a negative idf is replaced by
0.25 x the mean idf over the repository's vocabulary. Scores are rounded to 9 places before ranking
so that equal texts tie exactly whatever the order of summation; ties go to the smaller chunk id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.functions import tokenize
from chunkloom.schemas import BM25_CANDIDATES
from chunkloom.session import cut, spread

# Fixed values.
K1 = 1.5
B = 0.75
EPSILON = 0.25


@dataclass
class Bm25Index:
    """postings(repository_id, chunk_id, token, tf, doc_len); terms(repository_id, token, df);
    stats(repository_id, n_docs, avg_len, avg_idf). Write the three tables once per snapshot and
    pass them back in to serve many query batches."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def _idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def postings(chunks: DataFrame) -> DataFrame:
    """Term counts per chunk. All tokens of a chunk are in one row, so the partial aggregate before
    the shuffle already yields final counts."""
    tokens = spread(chunks.select("repository_id", "chunk_id", "content")).select(
        "repository_id", "chunk_id", tokenize("content").alias("tokens")
    )
    # The length is taken before the explode: read after it, it would carry the token array on every
    # row. The outer form keeps the optimizer from tokenizing again to test for empty arrays.
    sized = tokens.select("repository_id", "chunk_id", F.size("tokens").alias("doc_len"), "tokens")
    return (
        sized.select("repository_id", "chunk_id", "doc_len", F.explode_outer("tokens").alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("repository_id", "chunk_id", "token", "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def build_index(chunks: DataFrame) -> Bm25Index:
    """The three tables, each written once to the shared folder and read from there."""
    posted = cut(postings(chunks))
    terms = cut(posted.groupBy("repository_id", "token").agg(F.count(F.lit(1)).alias("df")))
    n_tokens = posted.groupBy("repository_id").agg(F.sum("tf").alias("n_tokens"))
    return Bm25Index(posted, terms, _stats(chunks, terms, n_tokens))


def _stats(chunks: DataFrame, terms: DataFrame, n_tokens: DataFrame) -> DataFrame:
    # Chunks without tokens count as documents too.
    sizes = chunks.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_docs")).join(
        n_tokens, "repository_id", "left"
    )
    # Mean idf from the histogram of df values: few rows per repository meet the join with N.
    histogram = terms.groupBy("repository_id", "df").agg(F.count(F.lit(1)).alias("n_terms"))
    mean_idf = (
        histogram.join(sizes, "repository_id")
        .groupBy("repository_id")
        .agg((F.sum(F.col("n_terms") * _idf(F.col("df"), F.col("n_docs"))) / F.sum("n_terms")).alias("avg_idf"))
    )
    stats = sizes.join(mean_idf, "repository_id", "left").select(
        "repository_id", "n_docs", (F.coalesce("n_tokens", F.lit(0)) / F.col("n_docs")).alias("avg_len"), "avg_idf"
    )
    return cut(stats)


def build_index_for(queries: DataFrame, chunks: DataFrame) -> Bm25Index:
    """The index of ``chunks`` with the postings that ``queries`` read; terms and statistics are over all tokens.

    The texts are tokenized once, into a stored table of token arrays. Frequencies need the distinct tokens of a row only,
    which are aggregated where they are read, so of all postings only those of asked tokens are shuffled and written.
    """
    key = ["repository_id", "chunk_id", "doc_len"]
    tokens = cut(spread(chunks.select("repository_id", "chunk_id", "content")).select("repository_id", "chunk_id", tokenize("content").alias("tokens")))
    sized = tokens.select("repository_id", "chunk_id", F.size("tokens").alias("doc_len"), "tokens").filter("doc_len > 0")
    # Rows of one key and length are one document, as postings are counted by both.
    again = cut(sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]))
    if not again.isEmpty():
        same = (
            sized["repository_id"].eqNullSafe(F.col("_repository_id")) & sized["chunk_id"].eqNullSafe(F.col("_chunk_id"))
            & (sized["doc_len"] == F.col("_doc_len"))
        )
        merged = sized.join(again, same, "left_semi").groupBy(*key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        sized = cut(sized.join(again, same, "left_anti").unionByName(merged))
    distinct = sized.select("repository_id", F.explode_outer(F.array_distinct("tokens")).alias("token"))
    terms = cut(distinct.groupBy("repository_id", "token").agg(F.count(F.lit(1)).alias("df")))
    n_tokens = sized.groupBy("repository_id").agg(F.sum(F.size("tokens").cast("long")).alias("n_tokens"))
    asked = cut(query_tokens(queries).select("repository_id", "token").distinct())
    posted = cut(
        sized.select(*key, F.explode_outer("tokens").alias("token")).join(asked, ["repository_id", "token"])
        .groupBy("repository_id", "chunk_id", "token", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    )
    return Bm25Index(posted, terms, _stats(chunks, terms, n_tokens))


def query_tokens(queries: DataFrame) -> DataFrame:
    """Distinct tokens per query, repeats as ``qtf``."""
    return (
        queries.select("repository_id", "query_id", F.explode(tokenize("query")).alias("token"))
        .groupBy("repository_id", "query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    )


def query_terms(tokens: DataFrame, index: Bm25Index) -> DataFrame:
    """Query tokens that occur in their repository, with the idf after the floor."""
    weighted = index.terms.join(tokens, ["repository_id", "token"]).join(index.stats, "repository_id")
    raw = _idf(F.col("df"), F.col("n_docs"))
    return weighted.select(
        "repository_id", "query_id", "token", "qtf", "avg_len",
        F.when(raw < 0, EPSILON * F.col("avg_idf")).otherwise(raw).alias("idf"),
    )


def scores(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """Positive scores of every (query, chunk) that share a token.

    The weighted query tokens are stored once, so their join with the postings is planned by their true size: a small
    batch filters the postings where they are read, a large one meets them in a shuffle, where adaptive execution
    splits the posting list of a common token.
    """
    terms = cut(query_terms(query_tokens(queries), index))
    weight = (
        F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1)
        / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    )
    return (
        index.postings.join(terms, ["repository_id", "token"])
        .groupBy("repository_id", "query_id", "chunk_id")
        .agg(F.round(F.sum(weight), 9).alias("bm25_score"))
        .filter(F.col("bm25_score") > 0)
    )


def search(
    queries: DataFrame, chunks: DataFrame | None = None, k: int | None = BM25_CANDIDATES, index: Bm25Index | None = None
) -> DataFrame:
    """Top ``k`` chunks per query (rank from 1), all with None. ``queries`` has repository_id, query_id, query."""
    index = index or build_index_for(queries, chunks)
    best = Window.partitionBy("repository_id", "query_id").orderBy(F.desc("bm25_score"), "chunk_id")
    ranked = scores(queries, index).withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)
