import hashlib
import hmac
import json

from pyspark.sql import functions as F

from chunkloom import functions as fx
from chunkloom.operators import deliveries, issues, validation
from chunkloom.schemas import PLAN
from chunkloom.sources.files import read_snapshot
from chunkloom.sources.issue_feed import read_issue_feed
from chunkloom.sources.tables import TableStore, cascade_delete


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_paths_and_names(spark):
    assert column(spark, ["src/app.py", "../../etc/passwd", "/etc/passwd", "~/secrets.py", "", "src//app.py"], fx.is_safe_relative_path("x")) == [True, False, False, False, False, False]
    assert column(spark, ["a.PY", "b/.py", "c.tsx", "d.tar.gz", "e", "f.yml"], fx.detect_language("x")) == ["python", None, "typescript", None, None, "yaml"]
    urls = ["https://github.com/octocat/Hello-World", "https://github.com/octocat/Hello-World.git", "git@github.com:octocat/Hello-World.git", "https://gitlab.com/a/b", "/tmp/repo/"]
    assert column(spark, urls, fx.full_name("x")) == ["octocat/Hello-World"] * 3 + [None, None]
    assert column(spark, urls, fx.repository_name("x")) == ["Hello-World"] * 3 + ["b", "repo"]
    assert column(spark, ["./foo", "a.b.c", "x/y/", "..."], fx.module_stem("x")) == ["foo", "c", "y", ""]
    assert column(spark, ["a/b.tar.gz", ".gitignore", "x/__init__.py"], fx.path_stem("x")) == ["b.tar", ".gitignore", "__init__"]
    assert column(spark, ["refs/heads/a/b", "refs/tags/v1", None], fx.branch_of("x")) == ["a/b", None, None]


def test_bytes_and_signatures(spark):
    assert column(spark, [b"hello\x00world", b"hello world\n"], fx.looks_binary("x"), "binary") == [True, False]
    assert column(spark, ["ok é".encode(), b"bad \xff."], fx.decode_lenient("x"), "binary") == ["ok é", "bad �."]
    body, secret = b'{"a": 1}', "k" * 80
    good = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    check = lambda b, h, s: column(spark, [b], fx.signature_valid("x", F.lit(h), s), "binary")[0]
    assert check(body, good, secret)
    assert not any([check(body, good, "other"), check(body + b" ", good, secret), check(body, None, secret), check(body, good, ""), check(body, good.replace("256", "1"), secret), check(body, "", secret)])


def test_issue_feed_and_sync(spark, tmp_path):
    rows = [
        {"id": 1, "number": 10, "title": "a", "labels": [{"name": "bug"}, "plain"], "state": "open", "html_url": "u", "user": {"login": "me"}, "updated_at": "2024-01-01T00:00:00Z"},
        {"id": 2, "number": 11, "title": "pr", "labels": [], "state": "open", "html_url": "u", "pull_request": None},
        {"id": 3, "number": 12, "title": "c", "state": "closed", "html_url": "u"},
    ]
    (tmp_path / "page.json").write_text("\n".join(json.dumps(r) for r in rows))
    feed = read_issue_feed(spark, str(tmp_path), "r")
    got = {r.github_issue_id: r for r in feed.collect()}
    assert set(got) == {1, 3} and got[1].labels == ["bug", "plain"] and got[1].author == "me" and got[3].labels == []
    repos = spark.createDataFrame([("r", "o/r"), ("bad", "norepo")], "repository_id string, full_name string")
    first = issues.sync_issues(feed, feed.limit(0), repos)
    assert first["stats"].first().asDict() == {"repository_id": "r", "created": 2, "updated": 0}
    again = issues.sync_issues(feed.withColumn("title", F.lit("new")), first["issues"].drop("change"), repos)
    assert again["stats"].first().asDict() == {"repository_id": "r", "created": 0, "updated": 2}
    assert {r.title for r in again["issues"].collect()} == {"new"}
    assert [r.repository_id for r in first["rejected"].collect()] == ["bad"]


def test_plan_rules(spark):
    def plan(citations=(), files=(), steps=(), confidence=0.9):
        return {"citations": [{"file_path": p, "start_line": 1, "end_line": 2, "claim": "c"} for p in citations], "affected_files": list(files),
                "implementation_steps": [{"step_number": n, "depends_on_steps": d} for n, d in steps], "confidence": confidence}

    cases = {"empty": plan(), "cited": plan(["seen.py"]), "bad": plan(["ghost.py"]), "file": plan(files=["none.py", "app.py"]), "step": plan(steps=[(1, [2]), (2, [1])]), "null": None}
    plans = spark.createDataFrame([(k, "r", v) for k, v in cases.items()], f"run_id string, repository_id string, plan {PLAN}")
    paths = spark.createDataFrame([(k, "seen.py") for k in cases], "run_id string, file_path string")
    files = spark.createDataFrame([("r", "app.py"), ("s", "none.py")], "repository_id string, path string")
    got = {r.run_id: (r.validation_errors, r.confidence) for r in validation.validate(plans, paths, files).collect()}
    assert got["empty"] == ([], 0.9) and got["cited"] == ([], 0.9)
    assert got["bad"] == (["Citation references 'ghost.py', which was never retrieved."], 0.4)
    assert got["file"] == (["affected_files references 'none.py', not found in the repo."], 0.4)
    assert got["step"] == (["Step 1 depends_on_steps references invalid step 2."], 0.4)
    assert got["null"] == (["No implementation plan was generated."], 0.4)


def test_push_outcomes_in_order(spark):
    repos = spark.createDataFrame([("A", 7, "o/a", "main"), ("B", None, "o/b", None)], "repository_id string, github_repo_id long, full_name string, default_branch string")
    rows = [("1", "refs/heads/main", False, 7, "x/y", None), ("2", "refs/heads/dev", False, 7, "x/y", "dev"), ("3", "refs/heads/main", True, 7, "o/a", None),
            ("4", "refs/tags/v", False, 7, "o/a", None), ("5", "refs/heads/main", False, 1, "no/no", None), ("6", "refs/heads/trunk", False, 8, "O/B", "trunk"),
            ("7", "refs/heads/main", False, 8, "o/b", "main")]
    pushes = spark.createDataFrame(rows, "delivery_id string, ref string, deleted boolean, github_repo_id long, full_name string, payload_branch string").withColumn(
        "received_at", F.timestamp_seconds(F.col("delivery_id").cast("long")))
    decided = deliveries.outcomes_in_order(deliveries.match_repository(pushes, repos))
    got = {r.delivery_id: r.outcome for r in decided.collect()}
    assert got == {"1": "queued", "2": "ignored_untracked_branch", "3": "ignored_deleted_branch", "4": "ignored_not_a_branch", "5": "ignored_unknown_repository",
                   "6": "queued", "7": "ignored_untracked_branch"}
    filled = {r.repository_id: (r.github_repo_id, r.full_name, r.default_branch) for r in deliveries.backfill(repos, decided).collect()}
    assert filled == {"A": (7, "o/a", "main"), "B": (8, "o/b", "trunk")}


def test_table_store_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), {"t": "repository_id string, v int"}, buckets=4)
    assert store.version() is None and store.read("t").count() == 0
    df = spark.createDataFrame([(f"r{i}", i) for i in range(20)], "repository_id string, v int")
    store.commit(1, {"t": df})
    assert store.read("t").count() == 20 and store.read("t", ["r3"]).collect()[0].v == 3
    touched = store.touched_buckets(spark.createDataFrame([("r3",)], "repository_id string"))
    now = store.read("t", buckets=touched)
    store.commit(2, {"t": now.filter("repository_id <> 'r3'")}, touched)
    assert store.version() == 2 and {r.v for r in store.read("t").collect()} == set(range(20)) - {3}
    left = cascade_delete({"t": df}, spark.createDataFrame([("r1",)], "repository_id string"))
    assert left["t"].count() == 19


def test_snapshot_reader(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "a.py").write_text("x = 1\n")
    rows = read_snapshot(spark, str(tmp_path / "repo"), "r").collect()
    assert [(r.repository_id, r.path, r.length, bytes(r.content)) for r in rows] == [("r", "src/a.py", 6, b"x = 1\n")]
