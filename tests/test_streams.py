import json

from pyspark.sql import functions as F

from chunkloom.functions.content import sign
from chunkloom.operators import progress, runs
from chunkloom.schemas import DELIVERIES, PROGRESS, RUN_EVENTS
from chunkloom.sources.deliveries import read_deliveries
from chunkloom.streaming.state import BatchNumbers, stored
from chunkloom.streaming import index as stream_index
from chunkloom.streaming import progress as stream_progress


def write_parts(spark, folder, rows, schema, parts=3):
    """One JSON file per part, so a stream reads them as separate batches."""
    import time

    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], schema)
        part.coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.05)
    return spark.read.schema(schema).json(str(folder)), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def ts(n):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=17 * n)


def test_run_status_stream_equals_batch(spark, tmp_path):
    names = ["approve", "started", "awaiting", "approve", "reject", "awaiting", "reject", "failed", "approve", "started"]
    rows = [(f"run{n % 2}", ts(n), n, names[(n * (1 + n % 2)) % 10]) for n in range(30)]
    batch, stream = write_parts(spark, tmp_path / "in", rows, RUN_EVENTS)
    stream_progress.write_run_status(stream, str(tmp_path / "state"), str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination()
    take = lambda df: sorted(tuple(r) for r in df.select("run_id", "status", "rejected_events").collect())
    judged = runs.judge(batch)
    assert take(stream_progress.run_status(spark, str(tmp_path / "state"))) == take(runs.latest(judged))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == judged.filter("NOT legal").count()
    # brute force over the state machine
    want = {}
    for run, _, _, event in rows:
        status, rejected = want.get(run, ("queued", 0))
        if event in runs.SETS:
            status = runs.SETS[event]
        elif status == "awaiting_approval":
            status = runs.DECISIONS[event]
        else:
            rejected += 1
        want[run] = (status, rejected)
    assert take(runs.latest(judged)) == sorted((k, *v) for k, v in want.items())


def test_late_run_events_do_not_turn_a_status_back(spark, tmp_path):
    rows = [("a", ts(1), 1, "started"), ("b", ts(1), 2, "started"), ("a", ts(9), 9, "failed"), ("a", ts(5), 5, "awaiting"), ("b", ts(6), 6, "awaiting"), ("b", ts(6), 5, "failed")]
    batch, stream = write_parts(spark, tmp_path / "in", rows, RUN_EVENTS)
    stream_progress.write_run_status(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {r.run_id: r.status for r in stream_progress.run_status(spark, str(tmp_path / "state")).collect()}
    assert got == {r.run_id: r.status for r in runs.latest(runs.judge(batch)).collect()} == {"a": "failed", "b": "awaiting_approval"}


def test_batch_numbers_grow_over_checkpoints(spark, tmp_path):
    used = []
    numbers = BatchNumbers(spark, str(tmp_path), lambda: used)
    given = [numbers.number(0, "one"), numbers.number(1, "one"), numbers.number(1, "one")]
    used += [0, 1]
    given += [numbers.number(0, "two"), numbers.number(1, "two"), numbers.number(2, "one")]
    assert given[:5] == [0, 1, 1, 2, 3] and stored(spark, f"{tmp_path}/streams") and not stored(spark, f"{tmp_path}/none")


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = []
    for n in range(60):
        event = [progress.STARTED, progress.DISCOVERED, progress.FILE, progress.FILE, progress.COMPLETED, progress.FAILED][(n * 7) % 6 if n % 20 else 0]
        data = {"count": n, "path": f"p{n}", "status": "added", "error": f"e{n}"}
        rows.append((f"r{n % 3}", ts(n), event, data))
    batch, stream = write_parts(spark, tmp_path / "in", rows, PROGRESS)
    stream_progress.write_status(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    take = lambda df: sorted((r.repository_id, r.stage, r.discovered_count, [x["path"] for x in r.recent_files], r.error) for r in df.collect())
    assert take(stream_progress.status(spark, str(tmp_path / "state"))) == take(progress.latest(batch))


def test_ingest_over_batches(spark, tmp_path):
    def delivery(i, repo, after, at, event="push"):
        body = json.dumps({"ref": "refs/heads/main", "before": "0", "after": after, "repository": {"id": repo, "full_name": f"o/{repo}"}, "x": 1})
        return (i, event, None, ts(at), bytearray(body.encode()))

    rows = [delivery("d1", 1, "c0", 1), delivery("d1", 1, "c0", 2), delivery("d2", 1, "c1", 3), delivery("d1", 1, "c9", 4),
            delivery("d3", 5, "c0", 5), ("d4", "push", None, ts(6), bytearray(b"junk"))]
    signed = spark.createDataFrame(rows, DELIVERIES).withColumn("signature", sign("body", "s"))
    for low, high in ((0, 2), (2, 4), (4, 6)):
        ids = [ts(a + 1) for a in range(low, high)]
        signed.filter(F.col("received_at").isin(ids)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    repos = spark.createDataFrame([("A", None, "O/1", "main")], "repository_id string, github_repo_id long, full_name string, default_branch string")
    tree = {"c0": "def a():\n    pass\n", "c1": "def b():\n    pass\n", "c9": "def never():\n    pass\n"}
    content = F.create_map(*[F.lit(x) for kv in tree.items() for x in kv])

    def snapshots(wanted):
        text = content[F.col("after")].cast("binary")
        return wanted.select("repository_id", F.col("after").alias("commit"), F.lit("a.py").alias("path"), F.octet_length(text).cast("long").alias("length"), text.alias("content"))

    stream = read_deliveries(spark, str(tmp_path / "in"), max_files=1)
    root = str(tmp_path / "out")
    stream_index.ingest(stream, "s", repos, root, str(tmp_path / "cp"), snapshots).awaitTermination()
    got = {r.delivery_id: (r.status, r.outcome) for r in spark.read.parquet(f"{root}/deliveries").collect()}
    assert got == {"d1": ("queued", "queued"), "d2": ("queued", "queued"), "d3": ("ignored", "ignored_unknown_repository"), "d4": ("failed", None)}
    assert spark.read.parquet(f"{root}/deliveries").count() == 4
    assert [c.symbol for c in stream_index.store_of(spark, root).read("chunks").collect()] == ["b"]
