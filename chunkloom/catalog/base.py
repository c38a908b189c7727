"""Registry and the shared views that map the test tables to corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as one chunk of the repository named by its source."""
    docs = table(spark, folder, "documents")
    first = F.regexp_extract("text", r"([\p{L}\p{N}_]{3,})", 1)
    return docs.select(
        F.col("source").alias("repository_id"),
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_path"),
        F.lit("markdown").alias("language"),
        F.nullif(first, F.lit("")).alias("symbol"),
        F.lit("section").alias("kind"),
        F.lit(1).alias("start_line"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("end_line"),
        F.col("text").alias("content"),
    )


DOC_CHUNKS = r"""
doc_chunks AS (
  SELECT source AS repository_id, doc_id AS chunk_id, source || '/' || doc_id || '.md' AS file_path,
         'markdown' AS language, nullif(regexp_extract(text, '([\p{L}\p{N}_]{3,})', 1), '') AS symbol,
         'section' AS kind, 1 AS start_line, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line,
         text AS content
  FROM documents)"""


def doc_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repository_id"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.join(docs, "chunk_id").select("repository_id", "chunk_id", "embedding")


DOC_VECTORS = """
doc_vectors AS (
  SELECT d.source AS repository_id, e.vec_id AS chunk_id, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


def bench_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark text as a query against one of the twenty repositories."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return (
        table(spark, folder, "benchmark").join(vectors, "item_id")
        .select(
            F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repository_id"),
            F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding",
        )
    )


BENCH_QUERIES = """
bench_queries AS (
  SELECT 'src' || (b.item_id % 20) AS repository_id, b.item_id AS query_id, b.text AS query,
         CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""

BM25 = (
    DOC_CHUNKS + "," + BENCH_QUERIES + r""",
tokens AS (
  SELECT repository_id, chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS toks FROM doc_chunks),
postings AS (
  SELECT repository_id, chunk_id, doc_len, token, count(*) AS tf
  FROM (SELECT repository_id, chunk_id, len(toks) AS doc_len, unnest(toks) AS token FROM tokens)
  GROUP BY ALL),
terms AS (SELECT repository_id, token, count(*) AS df FROM postings GROUP BY ALL),
sizes AS (SELECT repository_id, count(*) AS n_docs, sum(len(toks)) / count(*) AS avg_len FROM tokens GROUP BY ALL),
idfs AS (
  SELECT t.repository_id, t.token, t.df, s.n_docs, s.avg_len,
         ln((s.n_docs - t.df + 0.5) / (t.df + 0.5)) AS idf
  FROM terms t JOIN sizes s USING (repository_id)),
means AS (SELECT repository_id, avg(idf) AS avg_idf FROM idfs GROUP BY ALL),
query_tokens AS (
  SELECT repository_id, query_id, token, count(*) AS qtf
  FROM (SELECT repository_id, query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS token FROM bench_queries)
  GROUP BY ALL),
bm25_scores AS (
  SELECT q.repository_id, q.query_id, p.chunk_id,
         round(sum(q.qtf * (CASE WHEN i.idf < 0 THEN 0.25 * m.avg_idf ELSE i.idf END) * p.tf * 2.5
               / (p.tf + 1.5 * (0.25 + 0.75 * p.doc_len / i.avg_len))), 9) AS score
  FROM query_tokens q
  JOIN postings p USING (repository_id, token)
  JOIN idfs i USING (repository_id, token)
  JOIN means m USING (repository_id)
  GROUP BY ALL HAVING score > 0),
bm25_top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM bm25_scores QUALIFY rank <= 20)"""
)

DENSE = DOC_VECTORS + r""",
dense_top AS (
  SELECT q.repository_id, q.query_id, v.chunk_id,
         round(list_cosine_similarity(q.embedding, v.embedding), 12) AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.embedding, v.embedding), 12) DESC, v.chunk_id) AS rank
  FROM bench_queries q JOIN doc_vectors v USING (repository_id) QUALIFY rank <= 20)"""


def hybrid_ctes(top_k: int) -> str:
    """SQL of the hybrid search, up to the hits."""
    return (
        "WITH" + BM25 + "," + DENSE + f""",
fused AS (
  SELECT repository_id, query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused_score,
         max(CASE WHEN l = 0 THEN score END) AS dense_score, max(CASE WHEN l = 1 THEN score END) AS bm25_score,
         max(CASE WHEN l = 0 THEN rank END) AS dense_rank, max(CASE WHEN l = 1 THEN rank END) AS bm25_rank
  FROM (SELECT repository_id, query_id, chunk_id, score, rank, 0 AS l FROM dense_top
        UNION ALL SELECT repository_id, query_id, chunk_id, score, rank, 1 FROM bm25_top)
  GROUP BY repository_id, query_id, chunk_id),
hits AS (
  SELECT f.*, c.file_path, c.symbol, c.kind, c.start_line, c.end_line, c.content,
         coalesce(f.dense_score, f.fused_score) AS score,
         row_number() OVER (PARTITION BY f.query_id ORDER BY f.fused_score DESC, f.dense_rank ASC NULLS LAST, f.bm25_rank ASC, f.chunk_id) AS pos
  FROM fused f JOIN doc_chunks c USING (repository_id, chunk_id) QUALIFY pos <= {top_k})
"""
    )
