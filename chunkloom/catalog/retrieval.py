"""Search queries over documents, embeddings and benchmark texts."""

from pyspark.sql import Window, functions as F

from chunkloom.catalog.base import (
    BM25, BENCH_QUERIES, DENSE, bench_queries, doc_chunks, doc_vectors, hybrid_ctes, register, table,
)
from chunkloom.operators import bm25, dense, fusion, ivf, rerank
from chunkloom.operators.search import as_citations
from chunkloom.plans.retrieval import answer, hybrid_search
from chunkloom.session import cut


@register(
    "bm25_stats",
    "WITH" + BM25 + """
SELECT s.repository_id, s.n_docs, round(s.avg_len, 6) AS avg_len, round(m.avg_idf, 6) AS avg_idf,
       (SELECT count(*) FROM terms t WHERE t.repository_id = s.repository_id) AS vocabulary,
       (SELECT CAST(sum(t.df) AS BIGINT) FROM terms t WHERE t.repository_id = s.repository_id) AS postings
FROM sizes s JOIN means m USING (repository_id)""",
)
def bm25_stats(spark, folder):
    index = bm25.build_index(doc_chunks(spark, folder))
    vocabulary = index.terms.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("vocabulary"), F.sum("df").alias("postings")
    )
    return index.stats.join(vocabulary, "repository_id").select(
        "repository_id", "n_docs", F.round("avg_len", 6).alias("avg_len"), F.round("avg_idf", 6).alias("avg_idf"),
        "vocabulary", "postings",
    )


@register(
    "bm25_topk",
    "WITH" + BM25 + " SELECT repository_id, query_id, chunk_id, rank, round(score, 6) AS score FROM bm25_top WHERE rank <= 10",
)
def bm25_topk(spark, folder):
    hits = bm25.search(bench_queries(spark, folder), doc_chunks(spark, folder), k=10)
    return hits.select("repository_id", "query_id", "chunk_id", "rank", F.round("bm25_score", 6).alias("score"))


@register(
    "dense_topk",
    """
WITH q AS (
  SELECT CAST(e.label AS VARCHAR) AS repository_id, b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
v AS (SELECT CAST(label AS VARCHAR) AS repository_id, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
s AS (
  SELECT repository_id, query_id, chunk_id, round(list_cosine_similarity(q.embedding, v.embedding), 12) AS score
  FROM q JOIN v USING (repository_id))
SELECT repository_id, query_id, chunk_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM s QUALIFY rank <= 20""",
)
def dense_topk(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("repository_id"), F.col("vec_id").alias("chunk_id"), "embedding"
    )
    dense.check_dims(vectors)
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("chunk_id"))
    queries = vectors.join(items, "chunk_id").withColumnRenamed("chunk_id", "query_id")
    return dense.knn(queries, vectors).withColumn("score", F.round("dense_score", 6)).drop("dense_score")


@register("lsh_topk")
def lsh_topk(spark, folder):
    """Approximate search with its recall against the exact one."""
    queries, vectors = bench_queries(spark, folder), doc_vectors(spark, folder)
    exact = dense.knn(queries, vectors, 10).select("query_id", "chunk_id")
    near = dense.knn_lsh(queries, vectors, 10)
    found = near.join(exact.withColumn("in_exact", F.lit(1)), ["query_id", "chunk_id"], "left")
    return found.select(
        "query_id", "chunk_id", "rank", F.round("dense_score", 6).alias("score"),
        F.coalesce("in_exact", F.lit(0)).alias("in_exact"),
    )


@register(
    "ivf_topk",
    """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
q AS (SELECT v.* FROM benchmark b JOIN v ON v.vec_id = b.item_id)
SELECT q.vec_id AS query_id, least(20, (SELECT count(*) FROM v)) AS n_hits, 1.0::DOUBLE AS best_score,
       (SELECT count(*) FROM v) AS n_vectors, true AS recall_reached, true AS all_exact
FROM q""",
)
def ivf_topk(spark, folder):
    """Inverted-file search of all vectors as one repository: hits of each query, and the recall of 0.9 over all queries."""
    vectors = table(spark, folder, "embeddings").select(F.lit("all").alias("repository_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("chunk_id"))
    queries = vectors.join(items, "chunk_id").withColumnRenamed("chunk_id", "query_id")
    index = ivf.build(vectors, queries)
    near = cut(ivf.search(queries, index))
    exact = dense.knn(queries, vectors).select("query_id", "chunk_id", F.col("dense_score").alias("exact_score"))
    met = exact.join(near.select("query_id", "chunk_id", "dense_score"), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count("exact_score").alias("wanted"), F.count("dense_score").alias("found"),
        F.coalesce(F.bool_and(F.col("dense_score") == F.col("exact_score")), F.lit(True)).alias("all_exact"),
    )
    total = met.agg(F.sum("found").alias("found"), F.sum("wanted").alias("wanted")).first()
    reached = F.lit((total["found"] or 0) >= 0.9 * (total["wanted"] or 0)).alias("recall_reached")
    hits = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.max("dense_score"), 6).alias("best_score"))
    sizes = ivf.scored_pairs(queries, index).select("query_id", F.col("pairs").alias("n_vectors"))
    return hits.join(met.select("query_id", "all_exact"), "query_id").join(sizes, "query_id").withColumn("recall_reached", reached)


@register(
    "rrf_fusion",
    "WITH" + BM25 + "," + DENSE + """
SELECT repository_id, query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused_score, count(*) AS n_lists
FROM (SELECT repository_id, query_id, chunk_id, rank FROM dense_top
      UNION ALL SELECT repository_id, query_id, chunk_id, rank FROM bm25_top)
GROUP BY ALL""",
)
def rrf_fusion(spark, folder):
    queries = bench_queries(spark, folder)
    fused = fusion.rrf(dense.knn(queries, doc_vectors(spark, folder)), bm25.search(queries, doc_chunks(spark, folder)))
    lists = F.col("rank_0").isNotNull().cast("long") + F.col("rank_1").isNotNull().cast("long")
    return fused.select(
        "repository_id", "query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"), lists.alias("n_lists")
    )


HYBRID_OUT = """
SELECT repository_id, query_id, chunk_id, pos AS rank, file_path, end_line, round(score, 6) AS score,
       round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, round(fused_score, 6) AS fused_score
FROM hits"""


@register("hybrid_search", hybrid_ctes(10) + HYBRID_OUT)
def hybrid(spark, folder):
    hits = hybrid_search(bench_queries(spark, folder), doc_chunks(spark, folder), doc_vectors(spark, folder))
    scores = [F.round(c, 6).alias(c) for c in ("score", "dense_score", "bm25_score", "fused_score")]
    return hits.select("repository_id", "query_id", "chunk_id", "rank", "file_path", "end_line", *scores)


@register(
    "search_citations",
    hybrid_ctes(10) + """
SELECT query_id, pos AS rank, file_path, round(score, 6) AS score,
       file_path || ':' || start_line || '-' || end_line AS span, coalesce(symbol, kind) AS label
FROM hits""",
)
def search_citations(spark, folder):
    hits = hybrid_search(bench_queries(spark, folder), doc_chunks(spark, folder), doc_vectors(spark, folder))
    return as_citations(hits).select("query_id", "rank", "file_path", F.round("score", 6).alias("score"), "span", "label")


@register(
    "rerank_overlap",
    hybrid_ctes(40) + r""",
scored AS (
  SELECT h.*, len(list_intersect(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9_]+')),
                                 regexp_extract_all(lower(h.content), '[a-z0-9_]+')))::DOUBLE
              / len(list_distinct(regexp_extract_all(lower(q.query), '[a-z0-9_]+'))) AS overlap
  FROM hits h JOIN bench_queries q USING (query_id))
SELECT query_id, chunk_id, round(overlap, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, pos) AS rank
FROM scored QUALIFY rank <= 10""",
)
def rerank_overlap(spark, folder):
    hits = hybrid_search(
        bench_queries(spark, folder), doc_chunks(spark, folder), doc_vectors(spark, folder), scorer=rerank.token_overlap
    )
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@register(
    "extractive_answers",
    hybrid_ctes(8) + r""",
body AS (
  SELECT query_id, count(*) AS n_hits,
         string_agg('- ' || coalesce(symbol, kind) || ' (' || kind || ') in ' || file_path || ':' || start_line || '-' || end_line, chr(10) ORDER BY pos) AS body
  FROM hits GROUP BY query_id),
named AS (
  SELECT q.*, CASE WHEN contains(query, '''') AND NOT contains(query, '"')
              THEN '"' || replace(replace(query, '\', '\\'), chr(10), '\n') || '"'
              ELSE '''' || replace(replace(replace(query, '\', '\\'), chr(10), '\n'), '''', '\''') || '''' END AS quoted
  FROM bench_queries q)
SELECT n.repository_id, n.query_id, coalesce(b.n_hits, 0) AS n_hits,
       CASE WHEN b.n_hits IS NULL THEN 'No relevant code was found for: ' || n.quoted
            ELSE 'Found ' || b.n_hits || ' relevant location(s) for: ' || n.quoted || chr(10) || chr(10) || b.body END AS answer
FROM named n LEFT JOIN body b USING (query_id)""",
)
def extractive_answers(spark, folder):
    answers, _ = answer(bench_queries(spark, folder), doc_chunks(spark, folder), doc_vectors(spark, folder))
    return answers
