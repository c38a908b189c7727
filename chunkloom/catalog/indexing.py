"""Snapshot comparison, incremental decisions and indexing.

The old snapshot is the documents table. The new one is made from it by a class of each text (first
hex digit of its SHA-256): deleted, edited, moved, moved and edited, moved to an unsafe path, moved
to an unsupported extension, turned binary, or kept, plus some fresh files.
"""

from pyspark.sql import functions as F

from chunkloom.catalog.base import DOC_CHUNKS, doc_chunks, register, table
from chunkloom.catalog.text import FILES_SQL, LANGUAGE_SQL, documents_as_files
from chunkloom.functions import content_hash, detect_language
from chunkloom.operators import embed, incremental, snapshot, status
from chunkloom.operators.chunking import chunk_corpus
from chunkloom.plans import jobs as index_jobs
from chunkloom.plans.index import Corpus, apply_decisions, diff_of, empty_corpus, full_index, incremental_index
from chunkloom.session import cut
from chunkloom.sources.diffs import read_name_status
from chunkloom.sources.files import files_from_table, read_snapshot
from chunkloom.sources.tables import cascade_delete, merge_snapshot

KLASS = "substring(sha2(text, 256), 1, 1)"
MORE = "\none more line"


def old_files(spark, folder):
    return files_from_table(documents_as_files(spark, folder), "source", "path", "text")


def new_files(spark, folder):
    docs = documents_as_files(spark, folder).withColumn("k", F.expr(KLASS))
    k = F.col("k")
    changed = F.struct(
        F.when(k == "3", F.concat(F.lit("moved/"), "path")).when(k == "5", F.concat(F.lit("edited/"), "path"))
        .when(k == "6", F.concat(F.lit("../"), "path")).when(k == "7", F.concat("path", F.lit(".bin")))
        .otherwise(F.col("path")).alias("path"),
        F.when(k.isin("1", "2", "5"), F.concat("text", F.lit(MORE)))
        .when(k == "8", F.concat(F.decode(F.lit(b"\x00"), "UTF-8"), "text")).otherwise(F.col("text")).alias("text"),
    )
    fresh = F.struct(F.concat(F.lit("added/"), "path").alias("path"), F.concat(F.lit("fresh "), "text").alias("text"))
    # Both from one reading of the documents.
    made = F.explode(F.when(k == "4", F.array(changed, fresh)).otherwise(F.array(changed)))
    return files_from_table(docs.filter(k != "0").select("source", made.alias("f")).select("source", "f.*"), "source", "path", "text")


SNAPSHOTS = f"""
WITH {FILES_SQL},
klassed AS (SELECT source AS repository_id, path, text, substr(sha256(text), 1, 1) AS k FROM doc_files),
old_files AS (SELECT repository_id, path, text, sha256(text) AS hash, false AS nul FROM klassed),
new_files AS (
  SELECT repository_id, path, text, sha256(text) AS hash, nul FROM (
    SELECT repository_id,
           CASE k WHEN '3' THEN 'moved/' || path WHEN '5' THEN 'edited/' || path WHEN '6' THEN '../' || path
                  WHEN '7' THEN path || '.bin' ELSE path END AS path,
           CASE WHEN k IN ('1', '2', '5') THEN text || chr(10) || 'one more line' WHEN k = '8' THEN chr(0) || text ELSE text END AS text,
           k = '8' AS nul
    FROM klassed WHERE k <> '0'
    UNION ALL SELECT repository_id, 'added/' || path, 'fresh ' || text, false FROM klassed WHERE k = '4')),
changes AS (
  SELECT repository_id, path, o.hash AS old_hash, n.hash AS new_hash,
         CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM old_files o FULL JOIN new_files n USING (repository_id, path)),
gone AS (
  SELECT repository_id, old_hash AS hash, path AS old_path,
         row_number() OVER (PARTITION BY repository_id, old_hash ORDER BY substr(sha256(path), 1, 2), path) AS i
  FROM changes WHERE status = 'deleted'),
came AS (
  SELECT repository_id, new_hash AS hash, path,
         row_number() OVER (PARTITION BY repository_id, new_hash ORDER BY substr(sha256(path), 1, 2), path) AS i
  FROM changes WHERE status = 'new'),
renames AS (SELECT repository_id, hash, old_path, path FROM gone JOIN came USING (repository_id, hash, i))"""


def hashed(files):
    return files.select("repository_id", "path", content_hash("content").alias("content_hash"))


def changes_of(spark, folder):
    return snapshot.diff(hashed(old_files(spark, folder)), hashed(new_files(spark, folder)))


@register("snapshot_diff", SNAPSHOTS + " SELECT * FROM changes")
def snapshot_diff(spark, folder):
    return changes_of(spark, folder)


@register("removed_files", SNAPSHOTS + " SELECT repository_id, path FROM changes WHERE status = 'deleted'")
def removed_files(spark, folder):
    return snapshot.removed(hashed(old_files(spark, folder)), hashed(new_files(spark, folder)))


def left_over(spark, folder):
    """Texts of the deleted and of the new files that exact pairing leaves over."""
    old, new = old_files(spark, folder), new_files(spark, folder)
    changes = cut(snapshot.diff(hashed(old), hashed(new)))
    exact = snapshot.pair_renames(changes)
    key = ["repository_id", "path"]
    text = lambda files: files.select(*key, F.col("content").cast("string").alias("text"))
    gone = changes.filter("status = 'deleted'").select(*key).join(
        exact.select("repository_id", F.col("old_path").alias("path")), key, "left_anti")
    came = changes.filter("status = 'new'").select(*key).join(exact.select(*key), key, "left_anti")
    return cut(text(old).join(gone, key)), cut(text(new).join(came, key))


@register("rename_pairs", SNAPSHOTS + " SELECT repository_id, hash AS content_hash, old_path, path FROM renames")
def rename_pairs(spark, folder):
    return snapshot.pair_renames(changes_of(spark, folder))


@register(
    "similar_renames",
    SNAPSHOTS + r""",
left_gone AS (
  SELECT repository_id, path, text FROM old_files f
  WHERE NOT EXISTS (SELECT 1 FROM new_files n WHERE n.repository_id = f.repository_id AND n.path = f.path)
    AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.repository_id = f.repository_id AND r.old_path = f.path)),
left_came AS (
  SELECT repository_id, path, text FROM new_files f
  WHERE NOT EXISTS (SELECT 1 FROM old_files n WHERE n.repository_id = f.repository_id AND n.path = f.path)
    AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.repository_id = f.repository_id AND r.path = f.path)),
ol AS (SELECT repository_id, path, list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))) AS ls FROM left_gone),
nl AS (SELECT repository_id, path, list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))) AS ls FROM left_came),
pairs AS (
  SELECT o.repository_id, o.path AS old_path, n.path, len(list_intersect(o.ls, n.ls)) AS shared, len(o.ls) AS a, len(n.ls) AS b
  FROM ol o JOIN nl n USING (repository_id)),
scored AS (
  SELECT repository_id, old_path, path, shared::DOUBLE / (a + b - shared) AS ratio FROM pairs
  WHERE a > 0 AND b > 0 AND shared::DOUBLE / (a + b - shared) >= 0.5),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repository_id, old_path ORDER BY ratio DESC, path) AS r1,
         row_number() OVER (PARTITION BY repository_id, path ORDER BY ratio DESC, old_path) AS r2 FROM scored)
SELECT repository_id, old_path, path, round(ratio, 6) AS ratio FROM ranked WHERE r1 = 1 AND r2 = 1""",
)
def similar_renames(spark, folder):
    """Moves with edits among the files that exact pairing left over."""
    return snapshot.pair_similar_renames(*left_over(spark, folder)).withColumn("ratio", F.round("ratio", 6))


# All candidates in one order, each kept if both its files are free: pairs of classes by falling ratio and the MD5 of the
# classes' names, inside a pair of classes by path.
EDITED_RENAMES = (
    SNAPSHOTS.replace("WITH ", "WITH RECURSIVE ", 1) + r""",
left_gone AS (
  SELECT repository_id, path, text FROM old_files f
  WHERE NOT EXISTS (SELECT 1 FROM new_files n WHERE n.repository_id = f.repository_id AND n.path = f.path)
    AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.repository_id = f.repository_id AND r.old_path = f.path)),
left_came AS (
  SELECT repository_id, path, text FROM new_files f
  WHERE NOT EXISTS (SELECT 1 FROM old_files n WHERE n.repository_id = f.repository_id AND n.path = f.path)
    AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.repository_id = f.repository_id AND r.path = f.path)),
ol AS (SELECT repository_id, path, list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))) AS ls FROM left_gone),
nl AS (SELECT repository_id, path, list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))) AS ls FROM left_came),
pairs AS (
  SELECT o.repository_id, o.path AS old_path, n.path, len(list_intersect(o.ls, n.ls)) AS shared, len(o.ls) AS a, len(n.ls) AS b
  FROM ol o JOIN nl n USING (repository_id)),
scored AS (
  SELECT repository_id, old_path, path, shared::DOUBLE / (a + b - shared) AS ratio FROM pairs
  WHERE a > 0 AND b > 0 AND shared::DOUBLE / (a + b - shared) >= 0.5),
classes AS (
  SELECT repository_id, 'o' AS side, path, min(path) OVER (PARTITION BY repository_id, list_sort(ls)) AS class FROM ol WHERE len(ls) > 0
  UNION ALL SELECT repository_id, 'n', path, min(path) OVER (PARTITION BY repository_id, list_sort(ls)) FROM nl WHERE len(ls) > 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY repository_id, side, class ORDER BY substr(sha256(path), 1, 2), path) AS number FROM classes),
ordered AS (
  SELECT s.*, row_number() OVER (
    PARTITION BY s.repository_id ORDER BY s.ratio DESC, md5(o.class || chr(31) || n.class), o.number, n.number) AS i
  FROM scored s JOIN placed o ON o.side = 'o' AND o.repository_id = s.repository_id AND o.path = s.old_path
  JOIN placed n ON n.side = 'n' AND n.repository_id = s.repository_id AND n.path = s.path),
fold(repository_id, i, used_old, used_new) AS (
  SELECT DISTINCT repository_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM ordered
  UNION ALL
  SELECT f.repository_id, c.i,
         CASE WHEN list_contains(used_old, old_path) OR list_contains(used_new, path) THEN used_old ELSE list_append(used_old, old_path) END,
         CASE WHEN list_contains(used_old, old_path) OR list_contains(used_new, path) THEN used_new ELSE list_append(used_new, path) END
  FROM fold f JOIN ordered c ON c.repository_id = f.repository_id AND c.i = f.i + 1),
last AS (SELECT repository_id, max_by(used_old, i) AS used_old, max_by(used_new, i) AS used_new FROM fold GROUP BY repository_id),
matched AS (SELECT repository_id, unnest(used_old) AS old_path, unnest(used_new) AS path FROM last)"""
)


@register("edited_renames", EDITED_RENAMES + " SELECT repository_id, old_path, path, round(ratio, 6) AS ratio FROM matched JOIN scored USING (repository_id, old_path, path)")
def edited_renames(spark, folder):
    """Every deleted file and every new one in at most one pair, until no similar pair is left."""
    gone, came = left_over(spark, folder)
    return snapshot.match_similar_renames(gone, came).withColumn("ratio", F.round("ratio", 6))


@register(
    "name_status_parse",
    f"""WITH {FILES_SQL}, k AS (SELECT source AS repository_id, path, substr(sha256(text), 1, 1) AS k FROM doc_files)
SELECT repository_id,
       CASE WHEN k IN ('0', '1') THEN 'deleted' WHEN k IN ('2', '3') THEN 'renamed' WHEN k = '4' THEN 'copied'
            WHEN k IN ('7', '8', '9') THEN 'modified' ELSE 'added' END AS status,
       CASE WHEN k IN ('2', '3', '4') THEN 'to/' || path ELSE path END AS path,
       CASE WHEN k IN ('2', '3', '4') THEN path END AS old_path
FROM k WHERE k NOT IN ('5', '6')""",
)
def name_status_parse(spark, folder):
    docs = documents_as_files(spark, folder).withColumn("k", F.expr(KLASS))
    k, path = F.col("k"), F.col("path")
    line = (
        F.when(k.isin("0", "1"), F.concat(F.lit("D\t"), path))
        .when(k.isin("2", "3"), F.concat(F.lit("R087\t"), path, F.lit("\tto/"), path))
        .when(k == "4", F.concat(F.lit("C100\t"), path, F.lit("\tto/"), path))
        .when(k == "5", F.concat(F.lit("T\t"), path)).when(k == "6", F.lit(""))
        .when(k.isin("7", "8", "9"), F.concat(F.lit("M\t"), path)).otherwise(F.concat(F.lit("A\t"), path))
    )
    return read_name_status(docs.select(F.col("source").alias("repository_id"), line.alias("value")), ("repository_id",))


INDEXED = f"""
indexed AS (
  SELECT repository_id, path, hash, text, language FROM (SELECT *, {LANGUAGE_SQL} AS language FROM old_files)
  WHERE language IS NOT NULL AND strlen(text) <= 1000000),
usable AS (
  SELECT repository_id, path, hash, text, language FROM (SELECT *, {LANGUAGE_SQL} AS language FROM new_files)
  WHERE language IS NOT NULL AND strlen(text) <= 1000000 AND NOT nul)"""

# The same diff entries as the plan makes: exact renames against the indexed files.
DECISIONS = (
    SNAPSHOTS.replace("FROM old_files o FULL JOIN", "FROM indexed o FULL JOIN").replace("changes AS (", INDEXED.strip() + ",\nchanges AS (")
    + """,
entries AS (
  SELECT repository_id, CASE status WHEN 'new' THEN 'added' WHEN 'changed' THEN 'modified' ELSE 'deleted' END AS status, path, NULL::VARCHAR AS old_path
  FROM changes c WHERE status <> 'unchanged'
    AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.repository_id = c.repository_id AND
                    ((c.status = 'deleted' AND r.old_path = c.path) OR (c.status = 'new' AND r.path = c.path)))
  UNION ALL SELECT repository_id, 'renamed', path, old_path FROM renames),
decided AS (
  SELECT e.*, CASE
      WHEN e.path LIKE '../%' THEN 'skip'
      WHEN e.status = 'deleted' THEN 'delete'
      WHEN e.status = 'renamed' AND u.hash IS NULL THEN 'delete'
      WHEN e.status = 'renamed' AND u.hash = o.hash THEN 'patch'
      WHEN e.status = 'renamed' THEN 'reindex'
      WHEN u.hash IS NULL AND i.hash IS NOT NULL THEN 'delete'
      WHEN u.hash IS NULL THEN 'skip'
      WHEN i.hash = u.hash THEN 'nothing'
      WHEN i.hash IS NOT NULL THEN 'reindex' ELSE 'index' END AS action
  FROM entries e
  LEFT JOIN usable u ON u.repository_id = e.repository_id AND u.path = e.path
  LEFT JOIN indexed i ON i.repository_id = e.repository_id AND i.path = e.path
  LEFT JOIN indexed o ON o.repository_id = e.repository_id AND o.path = e.old_path)"""
)


def indexed_files(files):
    return incremental.readable(files).select(
        incremental.new_file_id().alias("file_id"), "repository_id", "path", "language", "content_hash"
    )


def decisions_of(spark, folder, indexed=None):
    new = new_files(spark, folder)
    indexed = cut(indexed_files(old_files(spark, folder))) if indexed is None else indexed
    return incremental.decide(diff_of(indexed, new), indexed, new)


@register("incremental_decisions", DECISIONS + " SELECT repository_id, status, path, old_path, action FROM decided")
def incremental_decisions(spark, folder):
    return decisions_of(spark, folder).select("repository_id", "status", "path", "old_path", "action")


def chunk_ctes(files: str, name: str) -> str:
    """Chunks of prose files: sections and whole files stay whole, code and JSON go by 60 lines."""
    return f"""
{name}_parts AS (
  SELECT repository_id, path, language, text, hash, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
  FROM (SELECT *, string_split(text, chr(10)) AS p FROM {files})),
{name} AS (
  SELECT repository_id, path, language, CASE WHEN language = 'yaml' THEN 'file' ELSE 'section' END AS kind,
         1 AS start_line, CAST(len(parts) AS INT) AS end_line, hash AS content_hash
  FROM {name}_parts WHERE language IN ('yaml', 'markdown')
  UNION ALL
  SELECT repository_id, path, language, 'block', CAST(g AS INT), CAST(least(g + 59, len(parts)) AS INT),
         sha256(array_to_string(parts[g:g + 59], chr(10)))
  FROM (SELECT *, unnest(range(1, len(parts) + 1, 60)) AS g FROM {name}_parts WHERE language NOT IN ('yaml', 'markdown')))"""


def numbered(name: str) -> str:
    return f"{name}_n AS (SELECT *, row_number() OVER (PARTITION BY repository_id, path, content_hash ORDER BY start_line) - 1 AS occurrence_no FROM {name})"


MERGE = (
    DECISIONS + "," + chunk_ctes("indexed", "old_chunks") + "," + chunk_ctes("usable", "new_chunks") + ","
    + numbered("old_chunks") + "," + numbered("new_chunks") + """,
old_re AS (SELECT c.* FROM old_chunks_n c JOIN decided d ON d.action = 'reindex' AND d.repository_id = c.repository_id AND d.path = c.path),
new_re AS (SELECT c.* FROM new_chunks_n c JOIN decided d ON d.action IN ('reindex', 'index') AND d.repository_id = c.repository_id AND d.path = c.path),
ops AS (
  SELECT repository_id, path, content_hash, occurrence_no,
         CASE WHEN n.kind IS NULL THEN 'delete' WHEN o.kind IS NULL THEN 'embed' ELSE 'reuse' END AS op
  FROM old_re o FULL JOIN new_re n USING (repository_id, path, content_hash, occurrence_no))"""
)


def prior_corpus(spark, folder):
    indexed = incremental.readable(old_files(spark, folder))
    files = indexed.withColumn("file_id", incremental.new_file_id())
    chunks = chunk_corpus(files.select("repository_id", "file_id", F.col("path").alias("file_path"), "language", "text"))
    # Both stand for the stored tables.
    chunks = cut(chunks.withColumn("chunk_id", incremental.new_chunk_id()))
    return Corpus(cut(indexed_files(old_files(spark, folder))), chunks)


@register("chunk_merge", MERGE + " SELECT repository_id, path AS file_path, content_hash, occurrence_no, op FROM ops")
def chunk_merge(spark, folder):
    prior = prior_corpus(spark, folder)
    result = apply_decisions(decisions_of(spark, folder, prior.files), prior, None, blobs=new_files(spark, folder))
    return result.chunk_ops.select("repository_id", "file_path", "content_hash", "occurrence_no", "op")


@register(
    "incremental_stats",
    MERGE + """,
chunk_counts AS (
  SELECT repository_id, count(*) FILTER (WHERE op = 'embed') AS created, count(*) FILTER (WHERE op = 'delete') AS stale FROM ops GROUP BY ALL),
dropped AS (
  SELECT c.repository_id, count(*) AS n FROM old_chunks c JOIN decided d ON d.action = 'delete' AND d.repository_id = c.repository_id
    AND c.path = coalesce(d.old_path, d.path) GROUP BY ALL)
SELECT d.repository_id, count(*) AS files_discovered,
       count(*) FILTER (WHERE action = 'index') AS files_added,
       count(*) FILTER (WHERE action = 'reindex' AND status <> 'renamed') AS files_modified,
       count(*) FILTER (WHERE action = 'patch' OR (action = 'reindex' AND status = 'renamed')) AS files_renamed,
       count(*) FILTER (WHERE action = 'delete') AS files_deleted,
       count(*) FILTER (WHERE action = 'skip') AS files_skipped,
       coalesce(any_value(cc.created), 0) AS chunks_created,
       coalesce(any_value(cc.stale), 0) + coalesce(any_value(dr.n), 0) AS chunks_deleted
FROM decided d LEFT JOIN chunk_counts cc USING (repository_id) LEFT JOIN dropped dr USING (repository_id)
GROUP BY d.repository_id""",
)
def incremental_stats(spark, folder):
    prior = prior_corpus(spark, folder)
    result = apply_decisions(decisions_of(spark, folder, prior.files), prior, None, blobs=new_files(spark, folder))
    return result.stats.drop("no_op")


FINAL_CHUNKS = (
    SNAPSHOTS + "," + INDEXED + "," + chunk_ctes("safe_usable", "new_chunks").replace(
        "new_chunks_parts AS", "safe_usable AS (SELECT * FROM usable WHERE path NOT LIKE '../%'), new_chunks_parts AS", 1)
    + " SELECT repository_id, path AS file_path, language, kind, start_line, end_line, content_hash FROM new_chunks"
)
CHUNK_OUT = ["repository_id", "file_path", "language", "kind", "start_line", "end_line", "content_hash"]


@register("incremental_index", FINAL_CHUNKS)
def incremental_index_query(spark, folder):
    """The edited snapshot applied as a diff to the index of the old one."""
    prior = prior_corpus(spark, folder)
    new = new_files(spark, folder).filter(incremental.is_safe_relative_path("path"))
    return incremental_index(diff_of(prior.files, new), new, prior).corpus.chunks.select(CHUNK_OUT)


@register("full_index", FINAL_CHUNKS)
def full_index_query(spark, folder):
    """The edited snapshot indexed as a whole over the old index: the same final chunks."""
    tracked = new_files(spark, folder).filter(incremental.is_safe_relative_path("path"))
    return full_index(tracked, prior_corpus(spark, folder)).corpus.chunks.select(CHUNK_OUT)


# Jobs of the repositories by the first hex digit of their hashed name: no new commit, no known base, or a new commit
# over a known one. Files of the new snapshot whose hashed path begins with an e can't be read.
JOB_KIND = "CASE WHEN substring(sha2(repository_id, 256), 1, 1) IN ('0', '1', '2', '3') THEN 'no_op' WHEN substring(sha2(repository_id, 256), 1, 1) IN ('4', '5', '6', '7') THEN 'full' ELSE 'step' END"
JOB_KIND_SQL = JOB_KIND.replace("sha2(repository_id, 256)", "sha256(repository_id)")
JOBS = (
    MERGE.replace("new_files AS (\n", "all_new AS (\n", 1)
    .replace("indexed AS (\n", f"""kinds AS (SELECT DISTINCT repository_id, {JOB_KIND_SQL} AS kind FROM klassed),
new_files AS (
  SELECT * FROM all_new WHERE sha256(path) NOT LIKE 'e%' AND repository_id NOT IN (SELECT repository_id FROM kinds WHERE kind = 'no_op')),
indexed AS (
""", 1)
    .replace("AS language FROM old_files)", """AS language FROM old_files f
    WHERE repository_id IN (SELECT repository_id FROM kinds WHERE kind = 'step')
      AND NOT EXISTS (SELECT 1 FROM all_new n WHERE n.repository_id = f.repository_id AND n.path = f.path AND sha256(n.path) LIKE 'e%'))""", 1)
    + f""",
chunk_counts AS (
  SELECT repository_id, count(*) FILTER (WHERE op = 'embed') AS created, count(*) FILTER (WHERE op = 'delete') AS stale FROM ops GROUP BY ALL),
dropped AS (
  SELECT c.repository_id, count(*) AS n FROM old_chunks c JOIN decided d ON d.action = 'delete' AND d.repository_id = c.repository_id
    AND c.path = coalesce(d.old_path, d.path) GROUP BY ALL),
whole AS (SELECT repository_id, count(DISTINCT (path, content_hash)) AS n FROM new_re GROUP BY ALL),
failed AS (
  SELECT repository_id, count(*) AS n FROM all_new JOIN kinds USING (repository_id)
  WHERE kind <> 'no_op' AND sha256(path) LIKE 'e%' AND {LANGUAGE_SQL} IS NOT NULL GROUP BY ALL),
acted AS (
  SELECT repository_id, count(*) AS files_discovered, count(*) FILTER (WHERE action = 'index') AS files_added,
         count(*) FILTER (WHERE action = 'reindex' AND status <> 'renamed') AS files_modified,
         count(*) FILTER (WHERE action = 'patch' OR (action = 'reindex' AND status = 'renamed')) AS files_renamed,
         count(*) FILTER (WHERE action = 'delete') AS files_deleted, count(*) FILTER (WHERE action = 'skip') AS files_skipped
  FROM decided GROUP BY ALL)
SELECT k.repository_id, kind = 'no_op' AS no_op, kind = 'full' AS fell_back_to_full_index,
       coalesce(files_discovered, 0) AS files_discovered, coalesce(files_added, 0) AS files_added, coalesce(files_modified, 0) AS files_modified,
       coalesce(files_renamed, 0) AS files_renamed, coalesce(files_deleted, 0) AS files_deleted, coalesce(files_skipped, 0) AS files_skipped,
       coalesce(w.n, 0) AS total_chunks, coalesce(created, 0) AS chunks_created, coalesce(stale, 0) + coalesce(d.n, 0) AS chunks_deleted,
       coalesce(f.n, 0) AS n_errors
FROM kinds k LEFT JOIN acted USING (repository_id) LEFT JOIN chunk_counts USING (repository_id) LEFT JOIN dropped d USING (repository_id)
LEFT JOIN whole w USING (repository_id) LEFT JOIN failed f USING (repository_id)"""
)


@register("job_report", JOBS)
def job_report(spark, folder):
    """Statistics of an index job for every repository: nothing to do, a full index, or a step from one commit to the next."""
    kind = F.expr(JOB_KIND)
    prior = prior_corpus(spark, folder)
    known = Corpus(prior.files.filter(kind == "step"), prior.chunks.filter(kind == "step"))
    files = new_files(spark, folder).withColumn("content", F.when(~F.sha2("path", 256).startswith("e"), F.col("content")))
    jobs = old_files(spark, folder).select("repository_id").distinct().select(
        "repository_id", F.when(kind == "no_op", "b").when(kind == "step", "a").alias("base_commit"), F.lit("b").alias("after_commit"))
    return index_jobs.run_jobs(jobs, files, known).report.drop("base_commit", "after_commit")


@register(
    "rename_patch",
    SNAPSHOTS + """
SELECT o.repository_id, coalesce(r.path, o.path) AS file_path, r.path IS NOT NULL AS moved, o.hash AS content_hash
FROM old_files o LEFT JOIN renames r ON r.repository_id = o.repository_id AND r.old_path = o.path""",
)
def rename_patch(spark, folder):
    old = old_files(spark, folder).withColumn("file_id", incremental.new_file_id())
    chunks = old.select("file_id", "repository_id", F.col("path").alias("file_path"), "path", content_hash("content").alias("content_hash"))
    renames = snapshot.pair_renames(changes_of(spark, folder)).select(
        incremental.new_file_id("repository_id", "old_path").alias("file_id"), F.col("path").alias("new_path")
    )
    patched = incremental.apply_renames(chunks, renames)
    return patched.select("repository_id", "file_path", (F.col("file_path") != F.col("path")).alias("moved"), "content_hash")


@register(
    "table_merge",
    """SELECT d.doc_id AS chunk_id, d.source AS repository_id,
       CASE WHEN coalesce(l.quality, -1) = 0 THEN 'low/' || d.lang ELSE d.lang END AS file_path, coalesce(l.quality, -1) = 1 AS updated
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0""",
)
def table_merge(spark, folder):
    """Toxic documents are deleted, good ones upserted, low-quality ones get another path."""
    labels = table(spark, folder, "labels")
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("repository_id"), F.col("lang").alias("file_path")
    )
    current = rows.withColumn("updated", F.lit(False))
    marked = rows.join(labels.withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    upserts = marked.filter("quality = 1 AND toxic = 0").select("chunk_id", "repository_id", "file_path").withColumn("updated", F.lit(True))
    deletes = marked.filter("toxic = 1")
    patches = marked.filter("quality = 0 AND toxic = 0").select("chunk_id", F.concat(F.lit("low/"), "file_path").alias("file_path"))
    return merge_snapshot(current, upserts, deletes, patches)


@register(
    "index_errors",
    SNAPSHOTS + f""" SELECT repository_id, path, CASE WHEN strlen(text) > 20000 THEN 'file is too large' ELSE 'file is binary' END AS error
FROM new_files WHERE {LANGUAGE_SQL} IS NOT NULL AND (strlen(text) > 20000 OR nul)""",
)
def index_errors(spark, folder):
    return incremental.unreadable(new_files(spark, folder), 20_000)


@register(
    "repo_counts",
    """WITH repos AS (SELECT DISTINCT source AS repository_id FROM documents UNION ALL SELECT n_name FROM nation),
f AS (SELECT source AS repository_id, count(*) AS n FROM documents GROUP BY ALL),
c AS (SELECT d.source AS repository_id, count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY ALL)
SELECT r.repository_id, coalesce(f.n, 0) AS indexed_file_count, coalesce(c.n, 0) AS indexed_chunk_count
FROM repos r LEFT JOIN f USING (repository_id) LEFT JOIN c USING (repository_id)""",
)
def repo_counts(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "repository_id")
    repositories = docs.select("repository_id").distinct().unionByName(
        table(spark, folder, "nation").select(F.col("n_name").alias("repository_id")))
    chunks = docs.join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return status.counts(repositories, docs, chunks)


@register(
    "overview",
    """WITH repos AS (
  SELECT source, count(*) AS n, CASE WHEN avg(toxic) > 0.15 THEN 'failed' WHEN avg(quality) > 0.6 THEN 'ready' ELSE 'indexing' END AS status
  FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT count(*) AS repositories, count(*) FILTER (WHERE status = 'ready') AS ready,
       count(*) FILTER (WHERE status IN ('queued', 'cloning', 'indexing')) AS active, CAST(sum(n) AS BIGINT) AS total_chunks FROM repos""",
)
def overview(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    repositories = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("indexed_chunk_count"),
        F.when(F.avg("toxic") > 0.15, "failed").when(F.avg("quality") > 0.6, "ready").otherwise("indexing").alias("status"),
    )
    return status.overview(repositories)


@register(
    "cascade_delete",
    """WITH gone AS (SELECT source FROM documents GROUP BY source HAVING avg(n_chars) > (SELECT avg(n_chars) FROM documents))
SELECT 'documents' AS name, source AS repository_id, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM gone) GROUP BY ALL
UNION ALL
SELECT 'labels', source, count(*) FROM labels JOIN documents USING (doc_id) WHERE source NOT IN (SELECT source FROM gone) GROUP BY ALL""",
)
def cascade_delete_query(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "repository_id")
    mean = docs.agg(F.avg("n_chars").alias("mean"))
    by_repo = docs.groupBy("repository_id").agg(F.avg("n_chars").alias("own"))
    gone = by_repo.join(F.broadcast(mean)).filter("own > mean").select("repository_id")  # one-row side
    labels = table(spark, folder, "labels").join(docs.select("doc_id", "repository_id"), "doc_id")
    kept = cascade_delete({"documents": docs, "labels": labels}, gone)
    counted = [
        df.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in kept.items()
    ]
    return counted[0].unionByName(counted[1])


@register("deterministic_embeddings")
def deterministic_embeddings(spark, folder):
    """Each distinct text embedded once, known ones not at all; one vector per document."""
    chunks = doc_chunks(spark, folder).withColumn("content_hash", content_hash("content"))
    vectors = embed.embed_new(chunks, None, embed.deterministic(64))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("chunk_id", "content_hash", F.size("embedding").alias("dims"), F.round(norm, 5).alias("norm"))


@register("snapshot_files")
def snapshot_files(spark, folder):
    """The table files themselves as a snapshot; only names and sizes are read."""
    return read_snapshot(spark, folder, "testdata", "*.parquet").select("repository_id", "path", "length")
