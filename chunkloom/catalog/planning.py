"""Planning queries: one run per repository, its queries the benchmark texts that search it."""

from pyspark.sql import functions as F

from chunkloom.catalog.base import bench_queries, doc_chunks, doc_vectors, hybrid_ctes, register, table
from chunkloom.catalog.graph import EDGES
from chunkloom.operators import context, evaluation, graph, history, validation
from chunkloom.plans.planning import default_plans, default_queries as default_queries_plan, planning_context, related_files, retrieve
from chunkloom.plans.retrieval import hybrid_search
from chunkloom.operators import bm25
from chunkloom.schemas import PLAN
from chunkloom.session import cut


def first_line(column="text"):
    return F.get(F.split(column, "\n", -1), F.lit(0))


def doc_issues(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("source").alias("repository_id"), F.col("doc_id").alias("number"), first_line().alias("title"),
        F.col("text").alias("body"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("html_url"),
    )


def doc_commits(spark, folder):
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("repository_id"),
        F.format_string("%d-%d", "conv_id", "turn").alias("sha"), F.col("turn").alias("ts"),
        first_line().alias("subject"), F.col("text").alias("message"),
    )


def run_queries(spark, folder):
    """Search queries with their run; the query number is the item's place."""
    return bench_queries(spark, folder).select(
        F.col("repository_id").alias("run_id"), F.col("query_id").alias("query_no"), "repository_id", "query_id", "query",
        "embedding", F.lit(-1).cast("long").alias("issue_number"),
    )


BEST = """
best AS (
  SELECT h.repository_id AS run_id, h.repository_id, h.chunk_id, arg_max(h.query_id, {key: h.score, tie: -h.query_id}) AS query_no, max(h.score) AS score
  FROM hits h GROUP BY ALL),
retrieved AS (
  SELECT b.*, c.file_path, c.symbol, c.kind, c.start_line, c.end_line, c.content,
         row_number() OVER (PARTITION BY run_id ORDER BY score DESC, query_no, chunk_id) AS rank
  FROM best b JOIN doc_chunks c USING (repository_id, chunk_id) QUALIFY rank <= 15)"""


@register(
    "multi_query_best",
    hybrid_ctes(8) + "," + BEST + " SELECT run_id, chunk_id, query_no, round(score, 6) AS score, rank FROM retrieved",
)
def multi_query_best(spark, folder):
    best = retrieve(run_queries(spark, folder), doc_chunks(spark, folder), doc_vectors(spark, folder))
    return best.select("run_id", "chunk_id", "query_no", F.round("score", 6).alias("score"), "rank")


@register(
    "related_files",
    hybrid_ctes(8) + "," + BEST + " SELECT run_id, string_agg(DISTINCT file_path, ' ' ORDER BY file_path) AS files FROM retrieved GROUP BY run_id",
)
def related_files_query(spark, folder):
    best = retrieve(run_queries(spark, folder), doc_chunks(spark, folder), doc_vectors(spark, folder))
    return related_files(best).select("run_id", F.array_join("related_files", " ").alias("files"))


# Every word of a benchmark text is a query of its own run.
WORD_QUERIES = r"""
word_queries AS (
  SELECT item_id AS run_id, 'src' || (item_id % 20) AS repository_id, item_id AS issue_number, unnest(w) AS query, unnest(range(1, len(w) + 1)) AS query_no
  FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark)),
history_terms AS (
  SELECT run_id, repository_id, issue_number, query_no, lower(trim(query)) AS term FROM word_queries WHERE query_no <= 5 AND length(trim(query)) >= 3)"""


def word_queries(spark, folder):
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("run_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repository_id"),
        F.col("item_id").alias("issue_number"),
        F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("query_no", "query"),
    )


ISSUE_SQL = """
issues AS (SELECT source AS repository_id, doc_id AS number, string_split(text, chr(10))[1] AS title, text AS body, 'https://example.com/' || doc_id AS html_url FROM documents),
issue_hits AS (
  SELECT t.run_id, t.query_no, i.number, i.title, i.html_url,
         row_number() OVER (PARTITION BY t.run_id, t.query_no ORDER BY i.number) AS r
  FROM history_terms t JOIN issues i ON i.repository_id = t.repository_id AND i.number <> t.issue_number
   AND (contains(lower(i.title), t.term) OR contains(lower(i.body), t.term)) QUALIFY r <= 5),
past AS (
  SELECT run_id, number, any_value(title) AS title, any_value(html_url) AS html_url, min(query_no) AS query_no,
         row_number() OVER (PARTITION BY run_id ORDER BY min(query_no), number) AS rank
  FROM issue_hits GROUP BY run_id, number QUALIFY rank <= 5)"""

COMMIT_SQL = """
commits AS (SELECT 'src' || (conv_id % 20) AS repository_id, conv_id || '-' || turn AS sha, turn AS ts, string_split(text, chr(10))[1] AS subject, text AS message FROM conversations),
commit_hits AS (
  SELECT t.run_id, t.query_no, c.sha, c.subject, row_number() OVER (PARTITION BY t.run_id, t.query_no ORDER BY c.ts DESC, c.sha) AS r
  FROM history_terms t JOIN commits c ON c.repository_id = t.repository_id
   AND (contains(lower(c.subject), t.term) OR contains(lower(c.message), t.term)) QUALIFY r <= 3),
log AS (
  SELECT run_id, sha, any_value(subject) AS subject, row_number() OVER (PARTITION BY run_id ORDER BY min({q: query_no, r: r}), sha) AS rank
  FROM commit_hits GROUP BY run_id, sha QUALIFY rank <= 8)"""


@register("related_issues", "WITH" + WORD_QUERIES + "," + ISSUE_SQL + " SELECT run_id, number, title, html_url, rank FROM past")
def related_issues(spark, folder):
    found = history.related_issues(word_queries(spark, folder), doc_issues(spark, folder))
    return found.select("run_id", "number", "title", "html_url", "rank")


@register("related_commits", "WITH" + WORD_QUERIES + "," + COMMIT_SQL + " SELECT run_id, sha, subject, rank FROM log")
def related_commits(spark, folder):
    return history.related_commits(word_queries(spark, folder), doc_commits(spark, folder)).select("run_id", "sha", "subject", "rank")


@register(
    "related_issues_uncut",
    "WITH" + WORD_QUERIES.replace("query_no <= 5 AND ", "") + "," + ISSUE_SQL.replace(" QUALIFY r <= 5", "").replace(" QUALIFY rank <= 5", "")
    + " SELECT run_id, number, title, html_url, rank FROM past",
)
def related_issues_uncut(spark, folder):
    """Every word of a text as a query, every issue kept, terms met by their trigrams."""
    found = history.related_issues(word_queries(spark, folder), doc_issues(spark, folder), k=None, max_queries=None, small_bytes=0)
    return found.select("run_id", "number", "title", "html_url", "rank")


@register(
    "related_commits_regex",
    "WITH" + WORD_QUERIES.replace("lower(trim(query)) AS term", r"trim(query) || '\W' AS term").replace("length(trim(query)) >= 3", "length(trim(query)) >= 1") + ","
    + COMMIT_SQL.replace("contains(lower(c.subject), t.term)", "regexp_matches(c.subject, t.term, 'i')").replace(
        "contains(lower(c.message), t.term)", "regexp_matches(c.message, t.term, 'i')")
    + " SELECT run_id, sha, subject, rank FROM log",
)
def related_commits_regex(spark, folder):
    """Words as patterns that end before a character that is part of no word; case is ignored, the class keeps its meaning."""
    asked = word_queries(spark, folder).withColumn("query", F.concat("query", F.lit(r"\W")))
    return history.related_commits(asked, doc_commits(spark, folder), regex=True).select("run_id", "sha", "subject", "rank")


CONTEXT = (
    hybrid_ctes(8) + "," + BEST + "," + EDGES + """,
seeds AS (SELECT run_id AS set_id, repository_id, chunk_id FROM retrieved),
near AS (
  SELECT s.set_id, s.repository_id, e.to_chunk_id AS chunk_id, e.edge_type FROM seeds s JOIN edges e ON e.from_chunk_id = s.chunk_id
  UNION ALL SELECT s.set_id, s.repository_id, e.from_chunk_id, e.edge_type FROM seeds s JOIN edges e ON e.to_chunk_id = s.chunk_id),
uniq AS (SELECT set_id, repository_id, chunk_id, min(edge_type) AS edge_type FROM near GROUP BY ALL),
related AS (
  SELECT u.set_id AS run_id, c.*, row_number() OVER (PARTITION BY u.set_id ORDER BY u.edge_type, u.chunk_id) AS rank
  FROM uniq u JOIN doc_chunks c USING (repository_id, chunk_id)
  WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.set_id = u.set_id AND s.chunk_id = u.chunk_id) QUALIFY rank <= 20),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY query_id) AS n FROM bench_queries),
history_terms AS (
  SELECT repository_id AS run_id, repository_id, -1 AS issue_number, query_id AS query_no, lower(trim(query)) AS term
  FROM numbered WHERE n <= 5 AND length(trim(query)) >= 3),""" + ISSUE_SQL + "," + COMMIT_SQL + """,
runs AS (SELECT repository_id AS run_id, arg_min(query, query_id) AS body FROM bench_queries GROUP BY ALL),
contexts AS (
  SELECT r.run_id, (SELECT count(*) FROM retrieved x WHERE x.run_id = r.run_id) AS retrieval_count,
    array_to_string(list_filter([
      '# Issue: ' || string_split(r.body, chr(10))[1], r.body, '', '## Analysis', 'Problem: ' || r.run_id, 'Desired behavior: ',
      'Requirements: a; b', '', '## Retrieved repository context',
      (SELECT string_agg('[' || file_path || ':' || start_line || '-' || end_line || '] ' || coalesce(symbol, kind) || chr(10) || content || chr(10), chr(10) ORDER BY rank)
       FROM retrieved x WHERE x.run_id = r.run_id),
      (SELECT '## Related symbols (heuristic reference graph — not resolved calls)' || chr(10) ||
         string_agg('[' || file_path || ':' || start_line || '-' || end_line || '] ' || coalesce(symbol, kind), chr(10) ORDER BY rank) FROM related x WHERE x.run_id = r.run_id),
      (SELECT '## Related past issues' || chr(10) || string_agg('#' || number || ' ' || title || ' (' || html_url || ')', chr(10) ORDER BY rank) FROM past x WHERE x.run_id = r.run_id),
      (SELECT '## Related commit history' || chr(10) || string_agg(sha || ' ' || subject, chr(10) ORDER BY rank) FROM log x WHERE x.run_id = r.run_id)
    ], lambda x: x IS NOT NULL), chr(10)) AS context
  FROM runs r)"""
)


def contexts_of(spark, folder):
    docs = doc_chunks(spark, folder)
    queries = run_queries(spark, folder)
    runs = queries.groupBy("run_id").agg(F.min_by("query", "query_no").alias("body")).select(
        "run_id", first_line("body").alias("title"), "body", F.col("run_id").alias("problem"),
        F.lit(None).cast("string").alias("desired_behavior"), F.array(F.lit("a"), F.lit("b")).alias("requirements"),
    )
    return planning_context(
        runs, queries, docs, doc_vectors(spark, folder), graph.references_near(docs), doc_issues(spark, folder), doc_commits(spark, folder)
    )


@register("context_render", CONTEXT + " SELECT run_id, sha256(context) AS context_hash, length(context) AS n_chars FROM contexts")
def context_render(spark, folder):
    rendered = contexts_of(spark, folder)["context"]
    return rendered.select("run_id", F.sha2("context", 256).alias("context_hash"), F.length("context").alias("n_chars"))


@register(
    "context_metrics",
    CONTEXT + " SELECT run_id, retrieval_count, length(context) AS context_chars, length(context) // 4 AS approx_tokens FROM contexts",
)
def context_metrics(spark, folder):
    return contexts_of(spark, folder)["metrics"]


# Plans made from label rows: citations and files that may or may not be known, steps that may be out of order.
PLANS_SQL = """
p AS (
  SELECT l.doc_id AS run_id, d.source AS repository_id, l.quality, l.toxic, d.source || '/' || d.doc_id || '.md' AS own,
         d.source || '/' || (d.doc_id + 1) || '.md' AS next, d.source || '/' || (d.doc_id + 20) || '.md' AS far
  FROM labels l JOIN documents d USING (doc_id)),
paths AS (SELECT run_id, own AS file_path FROM p WHERE quality = 1 UNION ALL SELECT run_id, next FROM p WHERE toxic = 1),
errors AS (
  SELECT run_id, 0 AS rule, 0 AS i, 'No implementation plan was generated.' AS error FROM p WHERE quality = 0 AND toxic = 1
  UNION ALL SELECT run_id, 1, 0, 'Citation references ''' || own || ''', which was never retrieved.' FROM p
    WHERE NOT (quality = 0 AND toxic = 1) AND (run_id, own) NOT IN (SELECT (run_id, file_path) FROM paths)
  UNION ALL SELECT run_id, 1, 1, 'Citation references ''' || next || ''', which was never retrieved.' FROM p
    WHERE NOT (quality = 0 AND toxic = 1) AND (run_id, next) NOT IN (SELECT (run_id, file_path) FROM paths)
  UNION ALL SELECT run_id, 2, 1, 'affected_files references ''' || far || ''', not found in the repo.' FROM p
    WHERE NOT (quality = 0 AND toxic = 1) AND far NOT IN (SELECT source || '/' || doc_id || '.md' FROM documents)
  UNION ALL SELECT run_id, 3, 0, 'Step 1 depends_on_steps references invalid step 2.' FROM p WHERE quality = 0 AND toxic = 0
  UNION ALL SELECT run_id, 3, 2, 'Step 3 depends_on_steps references invalid step 9.' FROM p WHERE toxic = 1 AND quality = 1)"""


def label_plans(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    path = lambda n: F.concat("source", F.lit("/"), (F.col("doc_id") + n).cast("string"), F.lit(".md"))
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    step = lambda n, deps: F.struct(F.lit(n).alias("step_number"), deps.alias("depends_on_steps"))
    cite = lambda n: F.struct(path(n).alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("c").alias("claim"))
    plan = F.struct(
        F.array(cite(0), cite(1)).alias("citations"), F.array(path(0), path(20)).alias("affected_files"),
        F.array(
            step(1, F.when(F.col("quality") == 0, ints(2)).otherwise(ints())), step(2, ints(1)),
            step(3, F.when(F.col("toxic") == 1, ints(1, 9)).otherwise(ints(1, 2))),
        ).alias("implementation_steps"),
        F.lit(0.7).alias("confidence"),
    ).cast(PLAN)
    plans = rows.select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("repository_id"),
        F.when(~((F.col("quality") == 0) & (F.col("toxic") == 1)), plan).alias("plan"),
    )
    paths = rows.filter("quality = 1").select(F.col("doc_id").alias("run_id"), path(0).alias("file_path")).unionByName(
        rows.filter("toxic = 1").select(F.col("doc_id").alias("run_id"), path(1).alias("file_path"))
    )
    files = docs.select(F.col("source").alias("repository_id"), path(0).alias("path"))
    return plans, paths, files


@register(
    "plan_validation",
    "WITH" + PLANS_SQL + """,
listed AS (SELECT run_id, string_agg(error, ' | ' ORDER BY rule, i) AS errors, count(*) AS n FROM errors GROUP BY run_id)
SELECT p.run_id, coalesce(l.errors, '') AS errors, coalesce(l.n, 0) AS n_errors,
       CASE WHEN l.n IS NULL THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM p LEFT JOIN listed l USING (run_id)""",
)
def plan_validation(spark, folder):
    checked = validation.validate(*label_plans(spark, folder))
    return checked.select(
        "run_id", F.array_join("validation_errors", " | ").alias("errors"), F.size("validation_errors").alias("n_errors"), "confidence"
    )


@register(
    "plan_eval",
    "WITH" + PLANS_SQL + """,
cases AS (
  SELECT run_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n_expected,
         NOT (quality = 0 AND toxic = 1) AS planned, quality, toxic FROM p),
scored AS (
  SELECT run_id, CASE WHEN planned AND quality = 1 THEN 0.5 ELSE 0 END AS precision,
         CASE WHEN n_expected = 0 OR NOT planned OR quality = 0 THEN 0 ELSE 1.0 / n_expected END AS recall,
         NOT planned OR (quality = 1 AND toxic = 1) AS citations_valid FROM cases)
SELECT count(*) AS cases, round(avg(precision::DOUBLE), 6) AS avg_precision, round(avg(recall::DOUBLE), 6) AS avg_recall,
       count(*) FILTER (WHERE NOT citations_valid) AS hallucinations FROM scored""",
)
def plan_eval(spark, folder):
    """Expected files are the retrieved paths of the plan's document."""
    plans, paths, _ = label_plans(spark, folder)
    seen = paths.groupBy("run_id").agg(F.collect_set("file_path").alias("retrieved"))
    none = F.array().cast("array<string>")
    cases = plans.join(seen, "run_id", "left").select(
        F.col("run_id").alias("case_id"), F.coalesce("retrieved", none).alias("expected"),
        F.coalesce("plan.affected_files", none).alias("predicted"),
        F.coalesce(F.transform("plan.citations", lambda c: c["file_path"]), none).alias("cited"),
        F.coalesce("retrieved", none).alias("retrieved"),
    )
    summary = evaluation.plan_summary(evaluation.plan_cases(cases))
    return summary.select("cases", F.round("avg_precision", 6).alias("avg_precision"), F.round("avg_recall", 6).alias("avg_recall"), "hallucinations")


@register(
    "retrieval_eval",
    hybrid_ctes(10) + """,
expected AS (SELECT query_id, chunk_id FROM bm25_top WHERE rank <= 3),
found AS (SELECT e.query_id, count(h.chunk_id) AS n, min(h.pos) AS first, count(*) AS total
          FROM expected e LEFT JOIN hits h USING (query_id, chunk_id) GROUP BY ALL)
SELECT query_id, round(n::DOUBLE / total, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank FROM found""",
)
def retrieval_eval(spark, folder):
    """How many of the three best lexical hits the hybrid result keeps."""
    queries, docs = bench_queries(spark, folder), doc_chunks(spark, folder)
    index = bm25.build_index_for(queries, docs)
    expected = bm25.search(queries, k=3, index=index).select("query_id", "chunk_id")
    report = evaluation.retrieval(hybrid_search(queries, docs, doc_vectors(spark, folder), index=index), expected, 10)
    return report.select("query_id", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@register(
    "default_queries",
    r"""SELECT doc_id, left(regexp_replace(coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))[1], 'issue'),
       '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 200) AS query FROM documents""",
)
def default_queries(spark, folder):
    return default_queries_plan(table(spark, folder, "documents").select("doc_id", "text"))


@register("default_plans", "SELECT item_id AS run_id, 0 AS n_citations, 0 AS n_files, 0 AS n_steps, 0.1::DOUBLE AS confidence FROM benchmark")
def default_plans_query(spark, folder):
    plans = default_plans(table(spark, folder, "benchmark").select(F.col("item_id").alias("run_id")))
    return plans.select(
        "run_id", F.size("plan.citations").alias("n_citations"), F.size("plan.affected_files").alias("n_files"),
        F.size("plan.implementation_steps").alias("n_steps"), "plan.confidence",
    )
