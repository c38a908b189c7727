"""Delivery, issue, progress and run queries over the events table."""

import uuid

from pyspark.sql import functions as F

from chunkloom.catalog.base import register, table
from chunkloom.catalog.indexing import CHUNK_OUT, FINAL_CHUNKS, new_files, old_files
from chunkloom.functions.content import sign, signature_valid
from chunkloom.operators import activity, deliveries, incremental, issues, progress, runs, status
from chunkloom.session import shared_folder
from chunkloom.sources.issue_feed import parse_issue_feed
from chunkloom.streaming import deliveries as stream_deliveries
from chunkloom.streaming import index as stream_index
from chunkloom.streaming import progress as stream_progress
from chunkloom.streaming.state import BatchNumbers, BatchState

SECRET = "shared secret"


def scratch(spark):
    """A fresh folder below the shared one for a stream's output, on whatever file system that is."""
    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def events_batch(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def push_columns():
    """Each pair of events is one delivery sent twice; the event type decides what was pushed."""
    user = F.col("user_id")
    return {
        "delivery_id": F.concat(F.lit("d"), F.floor(F.col("event_id") / 2).cast("string")),
        "event_type": F.when(F.col("event_type") == "error", "ping").otherwise("push"),
        "received_at": F.col("ts"),
        "ref": F.when(F.col("event_type") == "purchase", "refs/tags/v1").when(F.col("event_type") == "signup", "refs/heads/dev")
        .otherwise("refs/heads/main"),
        "deleted": user % 11 == 0,
        "github_repo_id": user,
        "full_name": F.concat(F.lit("ORG/nation_"), (user % 30).cast("string")),
        "payload_branch": F.when(user % 3 != 0, "main"),
        "before": F.lit("b"),
        "after": F.concat(F.lit("c"), F.col("event_id").cast("string")),
    }


def pushes_of(events):
    return events.select(*[c.alias(n) for n, c in push_columns().items()])


def nations(spark, folder):
    key = F.col("n_nationkey").cast("long")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("repository_id"), F.when(key % 2 == 1, key + 100).alias("github_repo_id"),
        F.concat(F.lit("org/"), "n_name").alias("full_name"),
        F.when(key % 3 == 0, "main").when(key % 3 == 1, "dev").alias("default_branch"),
    )


PUSHES = """
sent AS (
  SELECT event_id, 'd' || (event_id // 2) AS delivery_id, CASE WHEN event_type = 'error' THEN 'ping' ELSE 'push' END AS event_type,
         ts AS received_at, user_id, event_type AS source_type,
         CASE event_type WHEN 'purchase' THEN 'refs/tags/v1' WHEN 'signup' THEN 'refs/heads/dev' ELSE 'refs/heads/main' END AS ref,
         user_id % 11 = 0 AS deleted, user_id AS github_repo_id, 'ORG/nation_' || (user_id % 30) AS full_name,
         CASE WHEN user_id % 3 <> 0 THEN 'main' END AS payload_branch, 'c' || event_id AS after
  FROM events),
repos AS (
  SELECT n_name AS repository_id, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey + 100 END AS github_repo_id, 'org/' || n_name AS full_name,
         CASE n_nationkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' END AS default_branch FROM nation)"""

JUDGE = """,
matched AS (
  SELECT f.*, coalesce(i.repository_id, n.repository_id) AS repository_id,
         CASE WHEN i.repository_id IS NOT NULL THEN i.default_branch ELSE n.default_branch END AS default_branch
  FROM firsts f LEFT JOIN repos i ON i.github_repo_id = f.github_repo_id LEFT JOIN repos n ON lower(n.full_name) = lower(f.full_name)),
opening AS (
  SELECT repository_id, received_at, payload_branch FROM matched
  WHERE repository_id IS NOT NULL AND default_branch IS NULL AND NOT deleted AND ref = 'refs/heads/' || payload_branch
  QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY received_at, delivery_id) = 1),
judged AS (
  SELECT m.*, CASE WHEN m.deleted THEN 'ignored_deleted_branch'
      WHEN m.ref NOT LIKE 'refs/heads/%' THEN 'ignored_not_a_branch'
      WHEN m.repository_id IS NULL THEN 'ignored_unknown_repository'
      WHEN m.ref <> 'refs/heads/' || coalesce(m.default_branch, CASE WHEN m.received_at > o.received_at THEN o.payload_branch END, m.payload_branch)
        THEN 'ignored_untracked_branch' ELSE 'queued' END AS outcome
  FROM matched m LEFT JOIN opening o USING (repository_id))"""

FIRSTS = ", firsts AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY received_at) = 1)"
OUTCOME_OUT = "delivery_id", "repository_id", "outcome"


@register(
    "deliveries_dedup",
    "WITH" + PUSHES + FIRSTS + " SELECT delivery_id, event_type, received_at, ref, github_repo_id FROM firsts",
)
def deliveries_dedup(spark, folder):
    first = deliveries.dedup(pushes_of(events_batch(spark, folder)))
    return first.select("delivery_id", "event_type", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "ref", "github_repo_id")


def judged(spark, folder):
    first = deliveries.dedup(pushes_of(events_batch(spark, folder)))
    return deliveries.outcomes_in_order(deliveries.match_repository(first, nations(spark, folder)))


@register("push_outcomes", "WITH" + PUSHES + FIRSTS + JUDGE + " SELECT delivery_id, repository_id, outcome FROM judged")
def push_outcomes(spark, folder):
    return judged(spark, folder).select(*OUTCOME_OUT)


@register(
    "repo_backfill",
    "WITH" + PUSHES + FIRSTS + JUDGE + """,
seen AS (SELECT * FROM judged WHERE outcome IN ('queued', 'ignored_untracked_branch')),
first_seen AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY received_at, delivery_id) = 1),
first_queued AS (SELECT * FROM seen WHERE outcome = 'queued' AND payload_branch IS NOT NULL
                 QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY received_at, delivery_id) = 1)
SELECT r.repository_id, coalesce(r.github_repo_id, s.github_repo_id) AS github_repo_id, coalesce(r.full_name, s.full_name) AS full_name,
       coalesce(r.default_branch, q.payload_branch) AS default_branch
FROM repos r LEFT JOIN first_seen s USING (repository_id) LEFT JOIN first_queued q USING (repository_id)""",
)
def repo_backfill(spark, folder):
    return deliveries.backfill(nations(spark, folder), judged(spark, folder))


def signed(events):
    """Raw deliveries with bodies and headers, some wrong in every way the gate knows."""
    user = F.col("user_id")
    rows = events.select("*", *[c.alias(f"_{n}") for n, c in push_columns().items()])
    body = F.to_json(F.struct(
        F.col("_ref").alias("ref"), F.lit("b").alias("before"), F.col("_after").alias("after"), F.col("_deleted").alias("deleted"),
        F.struct(F.col("_github_repo_id").alias("id"), F.col("_full_name").alias("full_name"), F.col("_payload_branch").alias("default_branch")).alias("repository"),
        F.lit("ignored").alias("unknown_field"),
    ))
    rows = rows.withColumn("body", F.when(user % 17 == 0, F.lit("not json")).otherwise(body).cast("binary"))
    return rows.select(
        F.when(user % 13 == 0, F.lit("")).otherwise(F.col("_delivery_id")).alias("delivery_id"),
        F.col("_event_type").alias("event_type"),
        F.when((F.col("event_type") == "signup") & (user % 2 == 1), F.lit("sha256=00")).otherwise(sign("body", SECRET)).alias("signature"),
        F.col("ts").alias("received_at"), "body",
    )


GATE = "WITH" + PUSHES + """,
rejected AS (
  SELECT CASE WHEN user_id % 13 = 0 THEN '' ELSE delivery_id END AS delivery_id, event_type, received_at,
         CASE WHEN source_type = 'signup' AND user_id % 2 = 1 THEN '401' ELSE '400' END AS status
  FROM sent WHERE (source_type = 'signup' AND user_id % 2 = 1) OR user_id % 13 = 0),
admitted AS (SELECT * FROM sent WHERE NOT (source_type = 'signup' AND user_id % 2 = 1) AND user_id % 13 <> 0),
unique_ones AS (SELECT * FROM admitted QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY received_at) = 1),
firsts AS (SELECT * FROM unique_ones WHERE event_type = 'push' AND user_id % 17 <> 0)""" + JUDGE + """,
gated AS (
  SELECT delivery_id, event_type, received_at, CASE WHEN outcome = 'queued' THEN 'queued' ELSE 'ignored' END AS status, outcome, repository_id FROM judged
  UNION ALL
  SELECT delivery_id, event_type, received_at, CASE WHEN event_type = 'ping' THEN 'ignored' ELSE 'failed' END, NULL, NULL
  FROM unique_ones WHERE event_type = 'ping' OR user_id % 17 = 0
  UNION ALL
  SELECT delivery_id, event_type, received_at, status, NULL, NULL FROM rejected)"""


@register("delivery_gate", GATE + " SELECT delivery_id, event_type, received_at, status, outcome, repository_id FROM gated")
def delivery_gate(spark, folder):
    accepted, rejected = deliveries.gate(signed(events_batch(spark, folder)), SECRET, nations(spark, folder))
    columns = ["delivery_id", "event_type", "received_at", "status", "outcome", "repository_id"]
    aside = rejected.withColumn("status", F.col("reject").cast("string")).drop("reject")
    both = accepted.select(*columns).unionByName(aside, allowMissingColumns=True)
    return both.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


@register(
    "delivery_hourly",
    GATE + " SELECT date_trunc('hour', received_at) AS window_start, status, count(*) AS deliveries FROM gated WHERE status NOT IN ('400', '401') GROUP BY ALL",
)
def delivery_hourly(spark, folder):
    accepted, _ = deliveries.gate(signed(events_batch(spark, folder)), SECRET, nations(spark, folder))
    return deliveries.hourly(accepted).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("signature_check", """
SELECT CASE WHEN user_id % 13 = 0 THEN '' ELSE 'd' || (event_id // 2) END AS delivery_id, ts AS received_at,
       NOT (event_type = 'signup' AND user_id % 2 = 1) AS valid, false AS wrong_secret, false AS no_secret, false AS changed_body,
       false AS no_header, false AS wrong_prefix
FROM events""")
def signature_check(spark, folder):
    """Every way a signature can be wrong, per delivery."""
    rows = signed(events_batch(spark, folder))
    return rows.select(
        "delivery_id", "received_at", signature_valid("body", "signature", SECRET).alias("valid"),
        signature_valid("body", "signature", "other").alias("wrong_secret"),
        signature_valid("body", "signature", "").alias("no_secret"),
        signature_valid(F.concat("body", F.lit(b"!")), "signature", SECRET).alias("changed_body"),
        signature_valid("body", F.lit(None).cast("string"), SECRET).alias("no_header"),
        signature_valid("body", F.replace("signature", F.lit("sha256="), F.lit("sha1=")), SECRET).alias("wrong_prefix"),
    )


def progress_events(events):
    name = (
        F.when(F.col("event_type") == "signup", progress.STARTED).when(F.col("event_type") == "view", progress.FILE)
        .when(F.col("event_type") == "click", progress.DISCOVERED).when(F.col("event_type") == "purchase", progress.COMPLETED)
        .otherwise(progress.FAILED)
    )
    data = F.from_json(
        F.to_json(F.struct(
            F.floor("value").alias("count"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.lit("modified").alias("status"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
        )),
        PROGRESS_DATA,
    )
    return events.select(F.col("user_id").cast("string").alias("repository_id"), "ts", name.alias("event"), data.alias("data"))


PROGRESS_DATA = (
    "count long, path string, status string, error string, no_op boolean, fell_back_to_full_index boolean, files_discovered long, "
    "files_added long, files_modified long, files_deleted long, files_renamed long, chunks_created long, chunks_deleted long, "
    "errors long, duration_seconds double"
)

PROGRESS_SQL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS repository_id, * FROM events),
start AS (SELECT repository_id, max(ts) AS s FROM e WHERE event_type = 'signup' GROUP BY ALL),
live AS (SELECT e.* FROM e LEFT JOIN start USING (repository_id) WHERE s IS NULL OR ts >= s),
files AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY ts DESC) AS r FROM live WHERE event_type = 'view' QUALIFY r <= 8),
listed AS (SELECT repository_id, string_agg('p' || event_id, ' ' ORDER BY ts DESC) AS recent FROM files GROUP BY ALL),
agg AS (
  SELECT repository_id, arg_max(CAST(floor(value) AS BIGINT), ts) FILTER (WHERE event_type = 'click') AS discovered_count,
         arg_max(event_type, ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS ended,
         arg_max('e' || event_id, ts) FILTER (WHERE event_type = 'error') AS error,
         count(*) FILTER (WHERE event_type = 'click') AS d, count(*) FILTER (WHERE event_type = 'signup') AS st
  FROM live GROUP BY ALL)
SELECT a.repository_id, CASE WHEN ended = 'error' THEN 'failed' WHEN ended = 'purchase' THEN 'ready' WHEN l.recent IS NOT NULL THEN 'processing'
       WHEN d > 0 THEN 'discovering' WHEN st > 0 THEN 'fetching' ELSE 'connecting' END AS stage,
       discovered_count, coalesce(l.recent, '') AS recent, error
FROM agg a LEFT JOIN listed l USING (repository_id)"""


def progress_out(folded):
    return folded.select(
        "repository_id", "stage", "discovered_count",
        F.array_join(F.transform("recent_files", lambda r: r["path"]), " ").alias("recent"), "error",
    )


@register("progress_latest", PROGRESS_SQL)
def progress_latest(spark, folder):
    return progress_out(progress.latest(progress_events(events_batch(spark, folder))))


@register("stream_progress", PROGRESS_SQL)
def stream_progress_query(spark, folder):
    root = scratch(spark)
    query = stream_progress.write_status(progress_events(events_stream(spark, folder)), f"{root}/state", f"{root}/checkpoint")
    query.awaitTermination()
    return progress_out(stream_progress.status(spark, f"{root}/state"))


def run_events(events):
    name = (
        F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "awaiting")
        .when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "purchase", "reject").otherwise("failed")
    )
    return events.select(F.col("user_id").cast("string").alias("run_id"), "ts", F.col("event_id").alias("seq"), name.alias("event"))


RUNS_SQL = """WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'awaiting' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'reject' ELSE 'failed' END AS event
  FROM events),
placed AS (
  SELECT *, event NOT IN ('approve', 'reject') AS sets,
         count(*) FILTER (WHERE event NOT IN ('approve', 'reject')) OVER (PARTITION BY run_id ORDER BY ts, seq) AS segment FROM e),
since AS (
  SELECT *, max(CASE WHEN sets THEN event END) OVER (PARTITION BY run_id, segment) AS base,
         count(*) FILTER (WHERE NOT sets) OVER (PARTITION BY run_id, segment ORDER BY ts, seq) AS nth FROM placed),
judged AS (SELECT *, sets OR coalesce(segment > 0 AND base = 'awaiting' AND nth = 1, false) AS legal FROM since),
final AS (
  SELECT run_id, ts, seq, event, legal, CASE WHEN legal THEN CASE event WHEN 'started' THEN 'running' WHEN 'awaiting' THEN 'awaiting_approval'
         WHEN 'failed' THEN 'failed' WHEN 'approve' THEN 'approved' ELSE 'rejected' END END AS status FROM judged)"""

RUN_STATUS_SQL = RUNS_SQL + """
SELECT run_id, coalesce(arg_max(status, (ts, seq)) FILTER (WHERE legal), 'queued') AS status,
       count(*) FILTER (WHERE NOT legal) AS rejected_events FROM final GROUP BY run_id"""


@register("run_events", RUNS_SQL + " SELECT run_id, seq, event, legal, status FROM final")
def run_events_query(spark, folder):
    return runs.judge(run_events(events_batch(spark, folder))).select("run_id", "seq", "event", "legal", "status")


@register("run_status", RUN_STATUS_SQL)
def run_status(spark, folder):
    return runs.latest(runs.judge(run_events(events_batch(spark, folder))))


@register("stream_run_status", RUN_STATUS_SQL)
def stream_run_status(spark, folder):
    root = scratch(spark)
    query = stream_progress.write_run_status(run_events(events_stream(spark, folder)), f"{root}/state", f"{root}/checkpoint", f"{root}/rejected")
    query.awaitTermination()
    return stream_progress.run_status(spark, f"{root}/state")


@register(
    "job_durations",
    """SELECT user_id AS job_id, min(ts) FILTER (WHERE event_type = 'signup') AS started_at,
       max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS ended_at, count(*) FILTER (WHERE event_type = 'error') AS failures,
       round(epoch_us(max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) - min(ts) FILTER (WHERE event_type = 'signup')) / 1e6, 3) AS duration_seconds
FROM events GROUP BY user_id""",
)
def job_durations(spark, folder):
    name = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    events = table(spark, folder, "events").select(F.col("user_id").alias("job_id"), "ts", name.alias("event"))
    return status.job_durations(events).withColumn("duration_seconds", F.round("duration_seconds", 3))


@register(
    "activity_feed",
    """SELECT 'webhook' AS type, CAST(user_id AS VARCHAR) AS repository_id, event_type || ' ' || event_id AS title, ts FROM events
UNION ALL SELECT 'index', CAST(o_custkey AS VARCHAR), 'order ' || o_orderkey, o_orderdate FROM orders
UNION ALL SELECT 'agent_run', CAST(l_suppkey AS VARCHAR), l_orderkey || '-' || l_linenumber, l_shipdate FROM lineitem""",
)
def activity_feed(spark, folder):
    as_ = activity.as_activity
    text = lambda c: F.col(c).cast("string")
    return activity.feed(
        as_(table(spark, folder, "events"), "webhook", "ts", F.concat("event_type", F.lit(" "), text("event_id")), "user_id"),
        as_(table(spark, folder, "orders"), "index", "o_orderdate", F.concat(F.lit("order "), text("o_orderkey")), "o_custkey"),
        as_(table(spark, folder, "lineitem"), "agent_run", "l_shipdate", F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber")), "l_suppkey"),
    )


@register(
    "issue_sync",
    """WITH d AS (SELECT d.*, l.quality, coalesce(l.toxic, 0) AS toxic, string_split(text, chr(10))[1] AS line FROM documents d LEFT JOIN labels l USING (doc_id)),
rows AS (
  SELECT source AS repository_id, doc_id AS github_issue_id, CAST(doc_id AS INT) AS number, quality IS NOT NULL AS old, toxic = 0 AS fed, line, lang FROM d
  WHERE source <> 'src7' OR quality IS NOT NULL)
SELECT repository_id, github_issue_id, number, CASE WHEN fed AND repository_id <> 'src7' THEN line ELSE 'old title' END AS title,
       CASE WHEN fed AND repository_id <> 'src7' THEN lang || ' plain' ELSE '' END AS labels,
       CASE WHEN NOT fed OR repository_id = 'src7' THEN 'kept' WHEN old THEN 'updated' ELSE 'created' END AS change,
       CASE WHEN fed AND repository_id <> 'src7' THEN TIMESTAMP '2024-01-02 03:04:05' END AS github_updated_at
FROM rows WHERE old OR fed""",
)
def issue_sync(spark, folder):
    """Labelled documents are stored issues; the feed lists all documents, toxic ones as pull requests."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    line = F.get(F.split("text", "\n", -1), F.lit(0))
    item = F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("number"), line.alias("title"), F.col("text").alias("body"),
        F.struct(F.lit("bot").alias("login")).alias("user"), F.lit("open").alias("state"), F.lit("https://example.com").alias("html_url"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-02T03:04:05Z").alias("updated_at"),
    ))
    labels = F.concat(F.lit(',"labels":[{"name":"'), "lang", F.lit('"},"plain"]'))
    pull = F.when(F.coalesce("toxic", F.lit(0)) == 1, F.lit(',"pull_request":null')).otherwise("")
    value = F.concat(F.substring(item, F.lit(1), F.length(item) - 1), labels, pull, F.lit("}"))
    feed = parse_issue_feed(docs.select(F.col("source").alias("repository_id"), value.alias("value")))
    existing = docs.filter("quality IS NOT NULL").select(
        F.col("source").alias("repository_id"), F.col("doc_id").alias("github_issue_id"), F.col("doc_id").cast("int").alias("number"),
        F.lit("old title").alias("title"), "text", F.lit(None).cast("timestamp").alias("github_updated_at"),
    ).withColumn("body", F.col("text")).drop("text")
    for column, kind in (("author", "string"), ("labels", "array<string>"), ("state", "string"), ("html_url", "string"),
                         ("github_created_at", "timestamp"), ("github_closed_at", "timestamp")):
        existing = existing.withColumn(column, F.lit(None).cast(kind))
    repositories = docs.select(F.col("source").alias("repository_id")).distinct().withColumn(
        "full_name", F.when(F.col("repository_id") != "src7", F.concat(F.lit("org/"), "repository_id")))
    synced = issues.sync_issues(feed, existing.select(*feed.columns), repositories)["issues"]
    return synced.select(
        "repository_id", "github_issue_id", "number", "title", F.coalesce(F.array_join("labels", " "), F.lit("")).alias("labels"), "change",
        F.col("github_updated_at").cast("timestamp_ntz").alias("github_updated_at"),
    )


@register("stream_dedup", "WITH" + PUSHES + " SELECT DISTINCT delivery_id FROM sent")
def stream_dedup(spark, folder):
    root = scratch(spark)
    unique = stream_deliveries.dedup(pushes_of(events_stream(spark, folder)))
    stream_deliveries.run_available(unique, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("delivery_id")


@register(
    "stream_outcomes",
    "WITH" + PUSHES + """,
m AS (
  SELECT s.*, coalesce(i.repository_id, n.repository_id) AS repository_id,
         CASE WHEN i.repository_id IS NOT NULL THEN i.default_branch ELSE n.default_branch END AS default_branch
  FROM sent s LEFT JOIN repos i ON i.github_repo_id = s.github_repo_id LEFT JOIN repos n ON lower(n.full_name) = lower(s.full_name))
SELECT delivery_id, after, repository_id, CASE WHEN deleted THEN 'ignored_deleted_branch' WHEN ref NOT LIKE 'refs/heads/%' THEN 'ignored_not_a_branch'
  WHEN repository_id IS NULL THEN 'ignored_unknown_repository'
  WHEN ref <> 'refs/heads/' || coalesce(default_branch, payload_branch) THEN 'ignored_untracked_branch' ELSE 'queued' END AS outcome FROM m""",
)
def stream_outcomes(spark, folder):
    root = scratch(spark)
    decided = stream_deliveries.outcomes(pushes_of(events_stream(spark, folder)), nations(spark, folder))
    stream_deliveries.run_available(decided, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("delivery_id", "after", "repository_id", "outcome")


@register("stream_hourly")
def stream_hourly(spark, folder):
    """Closed hours only: append mode holds back those the watermark has not passed."""
    root = scratch(spark)
    pushes = stream_deliveries.outcomes(pushes_of(events_stream(spark, folder)), nations(spark, folder)).withColumnRenamed("outcome", "status")
    stream_deliveries.run_available(stream_deliveries.hourly(pushes), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("window_start timestamp, status string, deliveries long").parquet(f"{root}/out")


@register("delivery_ingest", GATE + " SELECT delivery_id, status, outcome, repository_id FROM gated WHERE status NOT IN ('400', '401')")
def delivery_ingest(spark, folder):
    """The whole delivery stream in one micro-batch: stored rows with their status."""
    root = scratch(spark)
    query = stream_index.ingest(signed(events_stream(spark, folder)), SECRET, nations(spark, folder), root, f"{root}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/deliveries").select("delivery_id", "status", "outcome", "repository_id")


@register(
    "stream_incremental",
    FINAL_CHUNKS + " WHERE repository_id IN (SELECT 'src' || (user_id % 20) FROM events)",
)
def stream_incremental(spark, folder):
    """Every event pushes its repository, first to the old snapshot, then to the new one."""
    root = scratch(spark)
    store = stream_index.store_of(spark, root)
    state = BatchState(spark, f"{root}/state", stream_index.INDEX_STATE)
    numbers = BatchNumbers(spark, root, state.batches)
    trees = {"c0": old_files(spark, folder), "c1": new_files(spark, folder).filter(incremental.is_safe_relative_path("path"))}
    for commit, tree in trees.items():
        pushes = events_stream(spark, folder).select(
            F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repository_id"), "ts"
        ).withColumn("after", F.lit(commit))

        def handle(batch, batch_id, commit=commit, tree=tree):
            newest = batch.groupBy("repository_id").agg(F.max_by("after", "ts").alias("after"))
            in_scope = lambda wanted: tree.join(wanted.select("repository_id"), "repository_id", "left_semi")
            stream_index.apply_pushes(newest, in_scope, store, state, numbers.number(batch_id, commit))

        stream_deliveries.each_batch(pushes, handle, f"{root}/checkpoint-{commit}").awaitTermination()
    return store.read("chunks").select(CHUNK_OUT)
