import datetime

from pyspark.sql import functions as F

from chunkloom.operators import progress
from chunkloom.plans.index import Corpus, empty_corpus, full_index
from chunkloom.plans.jobs import run_jobs
from chunkloom.session import cut

FILES = "repository_id string, commit string, path string, length long, content binary"


def snapshot(spark, trees):
    rows = [(r, "c", p, len(t or ""), None if t is None else bytearray(t.encode())) for r, tree in trees.items() for p, t in tree.items()]
    return spark.createDataFrame(rows, FILES)


def test_jobs_report_errors_and_progress(spark):
    old = {"still": {"a.py": "a = 1\n"}, "step": {"b.py": "b = 1\n", "torn.py": "t = 1\n", "out.py": "o = 1\n"}, "idle": {"i.py": "i = 1\n"}}
    new = {"still": {"a.py": "never = 0\n"}, "step": {"b.py": "b = 2\n", "torn.py": None, "c.py": "c = 1\n", "pic.png": None},
           "fresh": {"d.py": "d = 1\n", "../e.py": "e = 1\n"}}
    first = full_index(snapshot(spark, old), empty_corpus(spark)).corpus
    prior = Corpus(cut(first.files), cut(first.chunks))
    jobs = spark.createDataFrame([("still", "x", "x"), ("step", "x", "y"), ("fresh", None, "z"), ("bare", None, "z")],
                                 "repository_id string, base_commit string, after_commit string")
    done = run_jobs(jobs, snapshot(spark, new), prior, at=F.lit(datetime.datetime(2024, 5, 1)))
    rows = {r.repository_id: r.asDict() for r in done.report.collect()}
    assert set(rows) == {"still", "step", "fresh", "bare"}
    nothing = {"files_discovered": 0, "files_added": 0, "chunks_created": 0, "chunks_deleted": 0, "total_chunks": 0, "n_errors": 0}
    assert rows["still"].items() >= (nothing | {"no_op": True, "fell_back_to_full_index": False}).items()
    assert rows["bare"].items() >= (nothing | {"no_op": False, "fell_back_to_full_index": True}).items()
    assert rows["step"].items() >= {
        "no_op": False, "files_discovered": 3, "files_added": 1, "files_modified": 1, "files_deleted": 1, "n_errors": 1,
        "total_chunks": 2, "chunks_created": 2, "chunks_deleted": 2}.items()
    assert rows["fresh"].items() >= {"fell_back_to_full_index": True, "files_discovered": 2, "files_added": 1, "files_skipped": 1}.items()
    assert [tuple(r) for r in done.errors.collect()] == [("step", "torn.py", "content is missing")]
    left = {(r.repository_id, r.path) for r in done.corpus.files.collect()}
    assert left == {("still", "a.py"), ("step", "b.py"), ("step", "c.py"), ("step", "torn.py"), ("idle", "i.py"), ("fresh", "d.py")}
    seen = {r.repository_id: r for r in progress.latest(done.events).collect()}
    assert {r.stage for r in seen.values()} == {"ready"} and seen["step"].completed.errors == 1
    assert seen["step"].discovered_count == 3 and {f.path for f in seen["step"].recent_files} == {"b.py", "c.py", "out.py"}


def test_files_count_distinct_chunks(spark):
    from chunkloom.plans.jobs import file_results

    ops = spark.createDataFrame(
        [("r", "f", "h", "embed"), ("r", "f", "h", "reuse"), ("r", "f", "g", "delete"), ("r", "e", "g", "delete")],
        "repository_id string, file_id string, content_hash string, op string")
    assert {r.file_id: tuple(r)[2:] for r in file_results(ops).collect()} == {"f": (1, 1, 1), "e": (0, 0, 1)}
