"""Reference graph queries over documents; the symbol of a document is its first word of 3+ characters."""

from pyspark.sql import functions as F

from chunkloom.catalog.base import DOC_CHUNKS, doc_chunks, register
from chunkloom.operators import graph

# Mentions of one-word symbols, the cap by text order, and the edges.
EDGES = r"""
symbols AS (SELECT repository_id, symbol AS name, chunk_id FROM doc_chunks WHERE length(symbol) >= 3),
names AS (SELECT repository_id, name, count(*) AS n_targets FROM symbols GROUP BY ALL),
words AS (
  SELECT repository_id, chunk_id, name, min(pos) AS first
  FROM (SELECT repository_id, chunk_id, unnest(w) AS name, unnest(range(1, len(w) + 1)) AS pos
        FROM (SELECT repository_id, chunk_id, regexp_extract_all(content, '[\p{L}\p{N}_]+') AS w FROM doc_chunks))
  GROUP BY ALL),
mentions AS (
  SELECT w.*, n.n_targets FROM words w JOIN names n USING (repository_id, name)
  JOIN doc_chunks c USING (repository_id, chunk_id) WHERE c.symbol IS NULL OR c.symbol <> w.name),
kept AS (
  SELECT repository_id, chunk_id, name FROM (
    SELECT *, coalesce(sum(n_targets) OVER (PARTITION BY chunk_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
    FROM mentions) WHERE taken < 25),
edges AS (
  SELECT k.repository_id, k.chunk_id AS from_chunk_id, s.chunk_id AS to_chunk_id, 'references' AS edge_type
  FROM kept k JOIN symbols s USING (repository_id, name))"""

IMPORT_STEMS = r"""
import_chunks AS (
  SELECT repository_id, chunk_id, 'import ' || replace(content, ' ', ' import ') AS content FROM doc_chunks),
files AS (SELECT repository_id, chunk_id AS file_id, symbol AS stem FROM doc_chunks WHERE symbol IS NOT NULL),
toks AS (
  SELECT repository_id, chunk_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos
  FROM (SELECT repository_id, chunk_id, regexp_extract_all(content, '["'']([^"'']+)["'']|(?:from|import)\s+([\p{L}\p{N}_.]+)', 0) AS t FROM import_chunks)),
import_stems AS (
  SELECT repository_id, chunk_id, stem, min(pos) AS first FROM (
    SELECT repository_id, chunk_id, pos, regexp_extract(replace(
      CASE WHEN left(token, 1) IN ('"', '''') THEN token[2:-2] ELSE regexp_replace(token, '^(?:from|import)\s+', '') END, '.', '/'), '([^/]+)/*$', 1) AS stem
    FROM toks) GROUP BY ALL),"""

IMPORTS = IMPORT_STEMS + r"""
stem_sizes AS (SELECT repository_id, stem, count(*) AS n FROM files WHERE stem <> '__init__' GROUP BY ALL),
import_kept AS (
  SELECT repository_id, chunk_id, stem FROM (
    SELECT i.*, coalesce(sum(s.n) OVER (PARTITION BY chunk_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
    FROM import_stems i JOIN stem_sizes s USING (repository_id, stem)) WHERE taken < 25),
imports AS (
  SELECT k.repository_id, k.chunk_id AS from_chunk_id, f.file_id AS to_chunk_id, 'imports' AS edge_type
  FROM import_kept k JOIN files f USING (repository_id, stem) WHERE f.file_id <> k.chunk_id)"""

# Every file of every imported stem.
ALL_IMPORTS = IMPORT_STEMS + r"""
imports AS (
  SELECT k.repository_id, k.chunk_id AS from_chunk_id, f.file_id AS to_chunk_id, 'imports' AS edge_type
  FROM import_stems k JOIN files f USING (repository_id, stem) WHERE stem <> '__init__' AND f.file_id <> k.chunk_id)"""


def import_inputs(spark, folder):
    """Every word of a document becomes an import; files are named by the documents' symbols."""
    docs = doc_chunks(spark, folder)
    chunks = docs.withColumn("kind", F.lit("import")).withColumn("file_id", F.col("chunk_id")).withColumn(
        "content", F.concat(F.lit("import "), F.replace("content", F.lit(" "), F.lit(" import ")))
    )
    files = docs.filter(F.col("symbol").isNotNull()).select(
        "repository_id", F.col("chunk_id").alias("file_id"), F.concat("repository_id", F.lit("/"), "symbol", F.lit(".md")).alias("path")
    )
    return chunks, files


@register("reference_edges", "WITH" + DOC_CHUNKS + "," + EDGES + " SELECT * FROM edges")
def reference_edges(spark, folder):
    return graph.reference_edges(doc_chunks(spark, folder))


@register("import_edges", "WITH" + DOC_CHUNKS + "," + ALL_IMPORTS + " SELECT * FROM imports")
def import_edges(spark, folder):
    return graph.import_edges(*import_inputs(spark, folder), edge_cap=None)


@register(
    "graph_stats",
    "WITH" + DOC_CHUNKS + "," + EDGES + "," + IMPORTS + """,
made AS (
  SELECT c.repository_id, count(*) AS chunks_scanned,
         (SELECT count(*) FROM edges e WHERE e.repository_id = c.repository_id) AS references_created,
         (SELECT count(*) FROM imports e WHERE e.repository_id = c.repository_id) AS imports_created
  FROM doc_chunks c GROUP BY c.repository_id)
SELECT *, references_created + imports_created AS total_created FROM made""",
)
def graph_stats(spark, folder):
    docs = doc_chunks(spark, folder)
    edges = graph.reference_edges(docs, counted=True).unionByName(graph.import_edges(*import_inputs(spark, folder), counted=True))
    return graph.stats(docs, edges)


@register(
    "neighbours",
    "WITH" + DOC_CHUNKS + "," + EDGES + """,
seeds AS (SELECT d.repository_id AS set_id, d.repository_id, d.chunk_id FROM doc_chunks d JOIN benchmark b ON b.item_id = d.chunk_id),
near AS (
  SELECT s.set_id, s.repository_id, e.to_chunk_id AS chunk_id, e.edge_type FROM seeds s JOIN edges e ON e.from_chunk_id = s.chunk_id
  UNION ALL SELECT s.set_id, s.repository_id, e.from_chunk_id, e.edge_type FROM seeds s JOIN edges e ON e.to_chunk_id = s.chunk_id),
uniq AS (SELECT set_id, repository_id, chunk_id, min(edge_type) AS edge_type FROM near GROUP BY ALL)
SELECT u.set_id, u.chunk_id, c.file_path, 0.0::DOUBLE AS score,
       row_number() OVER (PARTITION BY u.set_id ORDER BY u.edge_type, u.chunk_id) AS rank
FROM uniq u JOIN doc_chunks c USING (repository_id, chunk_id)
WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.set_id = u.set_id AND s.chunk_id = u.chunk_id)
QUALIFY rank <= 20""",
)
def neighbours(spark, folder):
    docs = doc_chunks(spark, folder)
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("chunk_id"))
    seeds = docs.join(items, "chunk_id").select(F.col("repository_id").alias("set_id"), "repository_id", "chunk_id")
    near = graph.neighbours(seeds, graph.references_near(docs)(seeds), docs)
    return near.select("set_id", "chunk_id", "file_path", "score", "rank")
