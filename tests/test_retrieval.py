import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import bm25, dense, fusion, history, rerank
from chunkloom.operators.search import check_top_k, validate_queries
from chunkloom.plans.retrieval import extractive, hybrid_search

CHUNK = "repository_id string, chunk_id string, content string"
QUERY = "repository_id string, query_id string, query string"


def test_bm25_finds_the_identifier(spark):
    chunks = spark.createDataFrame(
        [("r", "1", "def calculate_total(items): return sum(items)"), ("r", "2", "class User: pass"), ("r", "3", "def greet(name): return name"),
         ("other", "9", "calculate_total")], CHUNK)
    queries = spark.createDataFrame([("r", "q", "calculate_total"), ("r", "none", "absent")], QUERY)
    got = [(h.query_id, h.chunk_id) for h in bm25.search(queries, chunks).orderBy("query_id", "rank").collect()]
    assert got == [("q", "1")]


def test_bm25_limit_and_repeats(spark):
    chunks = spark.createDataFrame([("r", str(i), "alpha " * (i % 3 + 1) + " ".join(f"w{i}{j}" for j in range(i))) for i in range(4)] + [("r", f"z{i}", "filler") for i in range(9)], CHUNK)
    one = bm25.search(spark.createDataFrame([("r", "q", "alpha")], QUERY), chunks, 3).collect()
    two = bm25.search(spark.createDataFrame([("r", "q", "alpha Alpha")], QUERY), chunks, 3).collect()
    assert len(one) == len(two) == 3
    a, b = ({r.chunk_id: r.bm25_score for r in x} for x in (one, two))
    assert all(abs(2 * a[c] - b[c]) < 1e-6 for c in a)


def test_rrf(spark):
    def ranked(*ids):
        return spark.createDataFrame([("r", "q", c, i + 1) for i, c in enumerate(ids)], "repository_id string, query_id string, chunk_id string, rank int")

    got = {r.chunk_id: r.fused_score for r in fusion.rrf(ranked("a", "b", "c"), ranked("a", "c", "b")).collect()}
    assert got["a"] == pytest.approx(2 / 61) and got["a"] > got["b"]
    flipped = {r.chunk_id: r.fused_score for r in fusion.rrf(ranked("a", "c", "b"), ranked("a", "b", "c")).collect()}
    assert got == flipped
    assert set(r.chunk_id for r in fusion.rrf(ranked("a", "b"), ranked("c")).collect()) == {"a", "b", "c"}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else "cold", i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [("hot", 1000 + i, rows[1][2]) for i in range(30)]  # copies tie exactly
    v = spark.createDataFrame(rows, "repository_id string, chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([("hot" if i % 2 else "cold", i, rows[i][2]) for i in range(12)] + [("none", 99, rows[0][2])],
                              "repository_id string, query_id long, embedding array<float>")
    return rows, q, v


def test_dense_scan_equals_grid_equals_brute_force(spark, vectors, monkeypatch):
    rows, q, v = vectors
    take = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.dense_score, 9)) for r in df.collect())
    scan = take(dense.knn(q, v, 7))
    monkeypatch.setattr(dense, "VECTORS_PER_CELL", 20)
    monkeypatch.setattr(dense, "QUERIES_PER_CELL", 2)
    assert take(dense.knn(q, v, 7, broadcast_bytes=0)) == scan
    brute = []
    for repo, qid, e in [(r.repository_id, r.query_id, r.embedding) for r in q.collect()]:
        e = np.array(e)
        scored = sorted((-round(float(np.float32(x) @ e / np.linalg.norm(np.float32(x)) / np.linalg.norm(e)), 9), c) for r, c, x in rows if r == repo)
        brute += [(qid, i + 1, c) for i, (s, c) in enumerate(scored[:7])]
    assert [r[:3] for r in scan] == sorted(brute)


def test_lsh_finds_most_and_dims_are_checked(spark, vectors):
    _, q, v = vectors
    exact = {(r.query_id, r.chunk_id) for r in dense.knn(q, v, 5).collect()}
    near = {(r.query_id, r.chunk_id) for r in dense.knn_lsh(q, v, 5, tables=24, bucket_length=1.0).collect()}
    assert len(exact & near) >= 0.8 * len(exact)
    assert dense.check_dims(v) == 8
    with pytest.raises(ValueError):
        dense.check_dims(v.limit(1).unionByName(spark.createDataFrame([("x", 1, [1.0])], v.schema)))


def test_hybrid_answers_and_validation(spark):
    chunks = spark.createDataFrame(
        [("r", "a", "a.py", "python", "foo", "function", 1, 2, "foo bar baz"), ("r", "b", "b.py", "python", None, "block", 1, 9, "other words here")],
        "repository_id string, chunk_id string, file_path string, language string, symbol string, kind string, start_line int, end_line int, content string")
    v = spark.createDataFrame([("r", "a", [1.0, 0.0]), ("r", "gone", [1.0, 0.1]), ("r", "b", [0.0, 1.0])], "repository_id string, chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("r", "q1", "foo's", [1.0, 0.0], 1), ("r", "q0", "", [1.0, 0.0], 3), ("s", "q2", "foo", [1.0, 0.0], 5), ("r", "q9", "foo", [1.0, 0.0], 99)],
                              "repository_id string, query_id string, query string, embedding array<float>, top_k int")
    hits = hybrid_search(q, chunks, v).collect()
    assert [(h.query_id, h.chunk_id, h["rank"], round(h.score, 6)) for h in hits] == [("q1", "a", 1, 1.0)]
    answers = {r.query_id: r.answer for r in extractive(q, hybrid_search(q.drop("top_k"), chunks, v)).collect()}
    assert answers["q1"].startswith("Found 2 relevant location(s) for: \"foo's\"\n\n- foo (function) in a.py:1-2\n- block (block) in b.py:1-9")
    assert answers["q2"] == "No relevant code was found for: 'foo'"
    reranked = hybrid_search(q.drop("top_k"), chunks, v, scorer=rerank.token_overlap).filter("query_id = 'q1'").orderBy("rank").collect()
    assert [h.chunk_id for h in reranked] == ["a", "b"] and reranked[0].score == 0.5
    assert validate_queries(q).count() == 2
    with pytest.raises(ValueError):
        check_top_k(51)


def test_history_paths_agree(spark):
    texts = spark.createDataFrame([("r", i, f"Fix Login {i} for {'oauth%' if i % 2 else 'Session_X'}", None if i % 3 else "token refresh") for i in range(20)],
                                  "repository_id string, number int, title string, body string")
    terms = spark.createDataFrame([(1, "r", 0, "login 1"), (1, "r", 1, "oauth%"), (1, "r", 2, "en ref"), (2, "r", 0, "session_x"), (2, "s", 1, "login")],
                                  "run_id int, repository_id string, query_no int, term string")
    take = lambda df: sorted((r.run_id, r.query_no, r.number) for r in df.select("run_id", "query_no", "number").collect())
    small = take(history.matches(terms, texts, ["title", "body"], ["number"]))
    large = take(history.matches(terms, texts, ["title", "body"], ["number"], small_bytes=0))
    assert small == large and len(small) == len(set(small)) and (1, 1, 1) in small
    assert take(history.matches(terms.filter("query_no = 0"), texts, ["title"], ["number"], regex=True)) == [t for t in small if t[1] == 0]


def test_index_for_queries_scores_as_the_full_one(spark):
    """Rows of one chunk and length are one document; keys may be null."""
    rows = [("r", "a", "one two two"), ("r", "a", "two one one"), ("r", "a", "two"), ("r", "b", "three one"), ("r", None, "one"), ("r", None, "two"), ("r", "c", None), ("r", "d", ""),
            (None, "e", "one"), ("s", "f", "one four")]
    chunks = spark.createDataFrame(rows, "repository_id string, chunk_id string, content string")
    queries = spark.createDataFrame([("r", "q1", "one two one"), ("s", "q2", "four five"), ("t", "q3", "one")], "repository_id string, query_id string, query string")
    full, part = bm25.build_index(chunks), bm25.build_index_for(queries, chunks)
    flat = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    assert flat(full.terms) == flat(part.terms.select(full.terms.columns)) and flat(full.stats) == flat(part.stats)
    asked = [("r", "one"), ("r", "two"), ("s", "four")]
    columns = full.postings.columns
    assert flat(part.postings.select(columns)) == [p for p in flat(full.postings) if (p[columns.index("repository_id")], p[columns.index("token")]) in asked]
    assert flat(bm25.search(queries, chunks)) == flat(bm25.search(queries, index=full))


def test_patterns_keep_their_case(spark):
    commits = spark.createDataFrame([("r", "a", 1, "ABC 123", None), ("r", "b", 2, "abc", "abcd")], "repository_id string, sha string, ts int, subject string, message string")
    queries = spark.createDataFrame([("run", "r", -1, n, q) for n, q in enumerate([r"abc\W", r"\D{4}$", r"b\Sd"])], "run_id string, repository_id string, issue_number int, query_no int, query string")
    found = history.related_commits(queries, commits, regex=True, per_term=None, k=None, max_queries=None).collect()
    assert sorted((r.sha, r.rank) for r in found) == [("a", 1), ("b", 2)]
    assert [r.sha for r in history.related_commits(queries.limit(1), commits, regex=True).collect()] == ["a"]


def test_issue_limits(spark):
    issues = spark.createDataFrame([("r", n, f"auth issue {n}", "zz" if n > 7 else None, "u") for n in range(10)],
                                   "repository_id string, number int, title string, body string, html_url string")
    queries = spark.createDataFrame([("run", "r", 0, 0, "zz zz"), ("run", "r", 0, 1, "ok"), ("run", "r", 0, 2, "issue 8"), ("run", "r", 0, 3, " AUTH "), ("run", "r", 0, 4, "x"), ("run", "r", 0, 5, "issue 9")],
                                    "run_id string, repository_id string, issue_number int, query_no int, query string")
    got = [r.number for r in history.related_issues(queries, issues).orderBy("rank").collect()]
    assert got == [8, 1, 2, 3, 4]
    assert F is not None
