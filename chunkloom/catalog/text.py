"""Queries over names, bytes, hashes and chunkers.

Files are made from the given rows inside the query, the same way in both languages: documents
carry no headings or code, so structure is added line by line to the whole text.
"""

from pyspark.sql import functions as F

from chunkloom import functions as fx
from chunkloom.catalog.base import DOC_CHUNKS, doc_chunks, register, table
from chunkloom.operators import chunking, conversations, incremental, status
from chunkloom.plans.registration import register as register_repositories_plan
from chunkloom.sources.files import files_from_table

# One extension per document, two of them unsupported.
EXTENSIONS = ["py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "md", "markdown", "json", "yaml", "yml", "txt", "PY"]


def documents_as_files(spark, folder):
    docs = table(spark, folder, "documents")
    names = F.array(*[F.lit(e) for e in EXTENSIONS])
    extension = F.get(names, (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return docs.withColumn("path", F.concat_ws("", "source", F.lit("/d."), F.col("doc_id").cast("string"), F.lit("."), extension))


EXT_SQL = "list_extract([" + ",".join(f"'{e}'" for e in EXTENSIONS) + f"], CAST(doc_id % {len(EXTENSIONS)} AS INT) + 1)"
FILES_SQL = f"doc_files AS (SELECT *, source || '/d.' || doc_id || '.' || {EXT_SQL} AS path FROM documents)"
LANGUAGE_SQL = (
    "CASE regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) "
    + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in fx.paths.EXTENSIONS.items()) + " END"
)


@register(
    "language_counts",
    f"WITH {FILES_SQL} SELECT source AS repository_id, language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars "
    f"FROM (SELECT *, {LANGUAGE_SQL} AS language FROM doc_files) WHERE language IS NOT NULL GROUP BY ALL",
)
def language_counts(spark, folder):
    files = documents_as_files(spark, folder).withColumn("language", fx.detect_language("path"))
    return (
        files.filter(F.col("language").isNotNull())
        .groupBy(F.col("source").alias("repository_id"), "language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))
    )


# Five paths from every page address: three of them unsafe.
PAGE_PATHS = r"""
page_paths AS (
  SELECT page_id, unnest([
    regexp_replace(url, '^[a-z]+://', ''), regexp_extract(url, '://[^/]*(/.*)$', 1),
    '~' || url, url, replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', '/../')]) AS path
  FROM pages)"""


@register(
    "safe_paths",
    "WITH" + PAGE_PATHS + r"""
SELECT page_id, path, path <> '' AND NOT starts_with(path, '/') AND NOT starts_with(path, '~')
       AND NOT list_contains(string_split(path, '/'), '..') AND NOT list_contains(string_split(path, '/'), '') AS safe
FROM page_paths""",
)
def safe_paths(spark, folder):
    url = F.col("url")
    forms = F.array(
        F.regexp_replace(url, "^[a-z]+://", ""), F.regexp_extract(url, r"://[^/]*(/.*)$", 1),
        F.concat(F.lit("~"), url), url,
        F.replace(F.regexp_replace(url, "^[a-z]+://[^/]*/", ""), F.lit("/"), F.lit("/../")),
    )
    paths = table(spark, folder, "pages").select("page_id", F.explode(forms).alias("path"))
    return paths.withColumn("safe", fx.is_safe_relative_path("path"))


# Each page address as it is, and as the two hosted forms.
PAGE_URLS = r"""
page_urls AS (
  SELECT page_id, unnest([url,
    regexp_replace(url, '^[a-z]+://([^/.]+)[^/]*/([a-z]+)/([0-9]+).*$', 'https://github.com/\1/\2-\3.git'),
    regexp_replace(url, '^[a-z]+://([^/.]+)[^/]*/([a-z]+)/([0-9]+).*$', 'git@github.com:\1/\2-\3/')]) AS url
  FROM pages)"""


def page_urls(spark, folder):
    pattern = r"^[a-z]+://([^/.]+)[^/]*/([a-z]+)/([0-9]+).*$"
    forms = F.array(
        "url", F.regexp_replace("url", pattern, "https://github.com/$1/$2-$3.git"),
        F.regexp_replace("url", pattern, "git@github.com:$1/$2-$3/"),
    )
    return table(spark, folder, "pages").select("page_id", F.explode(forms).alias("url"))


NAME_SQL = r"regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', '')"
FULL_NAME_SQL = r"""CASE WHEN regexp_extract(url, 'github\.com[:/]+([^/]+)/([^/]+?)(?:\.git)?/?$', 1) <> ''
       THEN regexp_extract(url, 'github\.com[:/]+([^/]+)/([^/]+?)(?:\.git)?/?$', 1) || '/' ||
            regexp_extract(url, 'github\.com[:/]+([^/]+)/([^/]+?)(?:\.git)?/?$', 2) END"""


@register(
    "repo_names",
    "WITH" + PAGE_URLS + f"""
SELECT page_id, url, coalesce(nullif(regexp_extract({NAME_SQL}, '([^/]*)$', 1), ''), {NAME_SQL}) AS name,
       {FULL_NAME_SQL} AS full_name FROM page_urls""",
)
def repo_names(spark, folder):
    return page_urls(spark, folder).select(
        "page_id", "url", fx.repository_name("url").alias("name"), fx.full_name("url").alias("full_name")
    )


@register(
    "register_repositories",
    "WITH" + PAGE_URLS + f""",
known AS (SELECT url FROM pages),
latest AS (SELECT url, max(page_id) AS page_id FROM page_urls WHERE url NOT IN (SELECT url FROM known) GROUP BY url)
SELECT url, page_id, coalesce(nullif(regexp_extract({NAME_SQL}, '([^/]*)$', 1), ''), {NAME_SQL}) AS name,
       {FULL_NAME_SQL} AS full_name, sha256(url) AS repository_id FROM latest""",
)
def register_repositories(spark, folder):
    """Page addresses are already registered; the hosted forms are new, the last page wins."""
    urls = page_urls(spark, folder).withColumn("seq", F.col("page_id"))
    new = register_repositories_plan(urls, table(spark, folder, "pages").select("url"))
    return new.select("url", "page_id", "name", "full_name", "repository_id")


@register(
    "content_hash_dups",
    "SELECT source AS repository_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def content_hash_dups(spark, folder):
    docs = table(spark, folder, "documents")
    return status.duplicates(docs.select(F.col("source").alias("repository_id"), fx.content_hash("text").alias("content_hash")))


# A NUL byte is put in front of toxic documents; the cap stands at 20 000 bytes.
BYTES_CAP = 20_000


@register(
    "binary_size_filter",
    f"WITH {FILES_SQL}" + f""", marked AS (
  SELECT f.*, coalesce(l.toxic, 0) = 1 AS nul, strlen(text) + CASE WHEN coalesce(l.toxic, 0) = 1 THEN 1 ELSE 0 END AS n
  FROM doc_files f LEFT JOIN labels l USING (doc_id))
SELECT source AS repository_id, {LANGUAGE_SQL} AS language, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes
FROM marked WHERE {LANGUAGE_SQL} IS NOT NULL AND n <= {BYTES_CAP} AND NOT nul GROUP BY ALL""",
)
def binary_size_filter(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    docs = documents_as_files(spark, folder).join(labels, "doc_id", "left")
    marked = docs.withColumn(
        "text", F.when(F.coalesce("toxic", F.lit(0)) == 1, F.concat(F.decode(F.lit(b"\x00"), "UTF-8"), "text")).otherwise(F.col("text"))
    )
    kept = incremental.readable(files_from_table(marked, "source", "path", "text"), BYTES_CAP)
    return kept.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def doc_text_files(spark, folder, text):
    docs = table(spark, folder, "documents")
    return docs.select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("path"), text.alias("text"))


def per_line(marker):
    """Text with ``marker(line, index)`` in place of every line."""
    return F.array_join(F.transform(F.split("text", "\n", -1), marker), "\n")


SPAN_OUT = "repository_id", "path", "symbol", "kind", "start_line", "end_line"


def spans_out(chunks):
    return chunks.select(*SPAN_OUT, F.sha2("content", 256).alias("content_hash"))


# Line table in SQL; the empty piece after a final line break is no line.
LINES_SQL = r"""
lines AS (
  SELECT repository_id, path, list_extract(parts, CAST(i AS INT)) AS line, CAST(i AS INT) AS line_no
  FROM (SELECT repository_id, path, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT repository_id, path,
                     CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
              FROM (SELECT repository_id, path, string_split(text, chr(10)) AS p FROM files)))),
sizes AS (SELECT repository_id, path, max(line_no) AS n FROM lines GROUP BY ALL)"""

SPAN_TEXT_SQL = r"""
SELECT s.repository_id, s.path, s.symbol, s.kind, s.start_line, s.end_line,
       sha256(string_agg(l.line, chr(10) ORDER BY l.line_no)) AS content_hash
FROM spans s JOIN lines l ON l.repository_id = s.repository_id AND l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line
GROUP BY ALL"""


@register(
    "fixed_windows",
    "WITH files AS (SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path, replace(text, ' ', chr(10)) AS text FROM documents),"
    + LINES_SQL + """,
spans AS (
  SELECT repository_id, path, NULL::VARCHAR AS symbol, 'block' AS kind,
         CAST(g AS INT) AS start_line, CAST(least(g + 59, n) AS INT) AS end_line
  FROM (SELECT repository_id, path, n, unnest(range(1, n + 1, 60)) AS g FROM sizes))""" + SPAN_TEXT_SQL,
)
def fixed_windows(spark, folder):
    """Windows over the whole texts, one word a line."""
    return spans_out(chunking.fixed_windows(doc_text_files(spark, folder, F.translate("text", " ", "\n"))))


@register(
    "markdown_sections",
    r"""WITH files AS (
  SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 3 = 2 THEN '## ' || l ELSE l END), chr(10)) AS text
  FROM documents),""" + LINES_SQL + r""",
heads AS (
  SELECT repository_id, path, line_no, regexp_replace(regexp_extract(line, '^#{1,6}[\s\p{Z}]+(.*)$', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS symbol,
         lead(line_no) OVER (PARTITION BY repository_id, path ORDER BY line_no) AS next_no
  FROM lines WHERE regexp_matches(line, '^#{1,6}[\s\p{Z}]+(.*)$')),
first_head AS (SELECT repository_id, path, min(line_no) AS first_no FROM heads GROUP BY ALL),
spans AS (
  SELECT h.repository_id, h.path, h.symbol, 'section' AS kind, h.line_no AS start_line,
         greatest(coalesce(h.next_no - 1, s.n), h.line_no) AS end_line
  FROM heads h JOIN sizes s USING (repository_id, path)
  UNION ALL
  SELECT f.repository_id, f.path, NULL, 'section', 1, f.first_no - 1
  FROM first_head f
  WHERE f.first_no > 1 AND EXISTS (SELECT 1 FROM lines l WHERE l.repository_id = f.repository_id AND l.path = f.path
        AND l.line_no < f.first_no AND regexp_matches(l.line, '[^\s\p{Z}]')))
SELECT s.repository_id, s.path, s.symbol, s.kind, s.start_line, s.end_line,
       sha256(string_agg(l.line, chr(10) ORDER BY l.line_no)) AS content_hash
FROM spans s JOIN lines l ON l.repository_id = s.repository_id AND l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line
GROUP BY ALL
UNION ALL
SELECT f.repository_id, f.path, NULL, 'section', 1, s.n, sha256(f.text)
FROM files f JOIN sizes s USING (repository_id, path)
WHERE NOT EXISTS (SELECT 1 FROM first_head h WHERE h.repository_id = f.repository_id AND h.path = f.path)
  AND regexp_matches(f.text, '[^\s\p{Z}]')""",
)
def markdown_sections(spark, folder):
    """Every third line of a document becomes a heading."""
    text = per_line(lambda l, i: F.when(i % 3 == 1, F.concat(F.lit("## "), l)).otherwise(l))
    return spans_out(chunking.markdown_sections(doc_text_files(spark, folder, text)))


ORDERS_JSON = r"""
  SELECT CAST(o_custkey AS VARCHAR) AS repository_id, CAST(o_orderkey AS VARCHAR) AS path,
         '{' || chr(10) || '  "order": ' || o_orderkey || ',' || chr(10) || '  "status": "' || o_orderstatus || '",' || chr(10)
         || '  "detail": {' || chr(10) || '    "priority": "' || o_orderpriority || '"' || chr(10) || '  },' || chr(10)
         || '  "priority": "' || o_orderpriority || '"' || chr(10) || '}' AS text
  FROM orders"""


def orders_text(spark, folder, pieces):
    orders = table(spark, folder, "orders")
    parts = [F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in pieces]
    return orders.select(
        F.col("o_custkey").cast("string").alias("repository_id"), F.col("o_orderkey").cast("string").alias("path"),
        F.concat(*parts).alias("text"),
    )


@register(
    "json_keys",
    "WITH files AS (" + ORDERS_JSON + ")," + LINES_SQL + """,
spans AS (
  SELECT repository_id, path, unnest(['order', 'status', 'detail', 'priority']) AS symbol, 'key' AS kind,
         unnest([2, 3, 4, 5]) AS start_line, unnest([2, 3, 4, 8]) AS end_line FROM files)""" + SPAN_TEXT_SQL,
)
def json_keys(spark, folder):
    """The nested key of the same name comes first in the text and takes the place of the outer one."""
    col = F.col
    files = orders_text(spark, folder, [
        '{\n  "order": ', [col("o_orderkey")], ',\n  "status": "', [col("o_orderstatus")],
        '",\n  "detail": {\n    "priority": "', [col("o_orderpriority")], '"\n  },\n  "priority": "',
        [col("o_orderpriority")], '"\n}',
    ])
    return spans_out(chunking.json_keys(files))


@register(
    "yaml_keys",
    r"""WITH files AS (
  SELECT CAST(o_custkey AS VARCHAR) AS repository_id, CAST(o_orderkey AS VARCHAR) AS path,
         '# order' || chr(10) || 'key: ' || o_orderkey || chr(10) || 'on: true' || chr(10) || 'status:' || chr(10) || '  key: ' || o_orderstatus
         || chr(10) || 'k' || (o_orderkey % 7) || ' : x' || chr(10) || 'key: again' || chr(10) || '- item' AS text
  FROM orders),""" + LINES_SQL + r""",
hits AS (
  SELECT repository_id, path, line_no, regexp_extract(line, '^([^\s#"''\[{\-%?&*!|>@`][^:]*?)\s*:(?:\s|$)', 1) AS symbol FROM lines),
firsts AS (
  SELECT repository_id, path, symbol, min(line_no) AS line_no FROM hits
  WHERE symbol <> '' AND symbol NOT IN ('on', 'yes', 'no', 'true', 'false', 'off', 'null') GROUP BY ALL),
spans AS (
  SELECT f.repository_id, f.path, f.symbol, 'key' AS kind, f.line_no AS start_line,
         coalesce(lead(f.line_no) OVER (PARTITION BY f.repository_id, f.path ORDER BY f.line_no) - 1, s.n) AS end_line
  FROM firsts f JOIN sizes s USING (repository_id, path))""" + SPAN_TEXT_SQL,
)
def yaml_keys(spark, folder):
    col = F.col
    files = orders_text(spark, folder, [
        "# order\nkey: ", [col("o_orderkey")], "\non: true\nstatus:\n  key: ", [col("o_orderstatus")],
        "\nk", [col("o_orderkey") % 7], " : x\nkey: again\n- item",
    ])
    return spans_out(chunking.yaml_keys(files))


# Lines become declarations and bodies by their place: a class, two methods with a nested function,
# a plain statement and a function in turn. The text of the document stays on its line.
PY_SHAPE_SQL = r"""
  SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
           CASE (i - 1) % 8
             WHEN 0 THEN 'class C' || i || ':' || chr(10) || '    # ' || l
             WHEN 1 THEN '    def m' || i || '(' || chr(10) || '        self,' || chr(10) || '    ):' || chr(10) || '        # ' || l
             WHEN 2 THEN '        def inner' || i || '():' || chr(10) || '            # ' || l
             WHEN 3 THEN '    async def m' || i || '(self):' || chr(10) || '        text = ' || repeat('"', 3) || chr(10) || l || chr(10) || '        ' || repeat('"', 3)
             WHEN 4 THEN chr(10) || 'x' || i || ' = 1  # ' || l
             WHEN 5 THEN 'def f' || i || '():' || chr(10) || '    # ' || l || chr(10)
             WHEN 6 THEN '    return ' || i
             ELSE 'y' || i || ' = 2  # ' || l END), chr(10)) AS text
  FROM documents"""


def python_shape(spark, folder):
    lit = F.lit

    def shape(l, i):
        n = (i + 1).cast("string")
        c = F.concat
        return (
            F.when(i % 8 == 0, c(lit("class C"), n, lit(":\n    # "), l))
            .when(i % 8 == 1, c(lit("    def m"), n, lit("(\n        self,\n    ):\n        # "), l))
            .when(i % 8 == 2, c(lit("        def inner"), n, lit("():\n            # "), l))
            .when(i % 8 == 3, c(lit("    async def m"), n, lit('(self):\n        text = """\n'), l, lit('\n        """')))
            .when(i % 8 == 4, c(lit("\nx"), n, lit(" = 1  # "), l))
            .when(i % 8 == 5, c(lit("def f"), n, lit("():\n    # "), l, lit("\n")))
            .when(i % 8 == 6, c(lit("    return "), n))
            .otherwise(c(lit("y"), n, lit(" = 2  # "), l))
        )

    return doc_text_files(spark, folder, per_line(shape))


@register(
    "python_decls",
    "WITH files AS (" + PY_SHAPE_SQL + ")," + LINES_SQL + r""",
facts AS (
  SELECT *, regexp_matches(line, '[^\s\p{Z}]') AS filled,
         length(replace(regexp_extract(line, '^[ \t]*'), chr(9), '        ')) AS indent,
         regexp_extract(line, '^\s*(?:async\s+)?(def|class)\s+([\p{L}_][\p{L}\p{N}_]*)', 1) AS word,
         regexp_extract(line, '^\s*(?:async\s+)?(def|class)\s+([\p{L}_][\p{L}\p{N}_]*)', 2) AS name,
         regexp_replace(line, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|#.*$', '', 'g') AS quiet,
         (length(line) - length(replace(line, repeat('"', 3), ''))) // 3 + (length(line) - length(replace(line, repeat('''', 3), ''))) // 3 AS quotes
  FROM lines),
quoted AS (
  SELECT *, coalesce(sum(quotes) OVER (PARTITION BY repository_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside
  FROM facts),
deltas AS (
  SELECT *, CASE WHEN inside OR quotes > 0 THEN 0 ELSE
      length(regexp_replace(quiet, '[^(\[{]', '', 'g')) - length(regexp_replace(quiet, '[^)\]}]', '', 'g')) END AS delta
  FROM quoted),
sums AS (SELECT *, sum(delta) OVER (PARTITION BY repository_id, path ORDER BY line_no) AS total FROM deltas),
depths AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY repository_id, path ORDER BY line_no)) AS after FROM sums),
marked AS (
  SELECT *, filled AND NOT inside AND coalesce(lag(after) OVER (PARTITION BY repository_id, path ORDER BY line_no), 0) <= 0 AS structural,
         max(CASE WHEN filled THEN line_no END) OVER (PARTITION BY repository_id, path ORDER BY line_no) AS last_filled
  FROM depths),
ends AS (
  SELECT d.repository_id, d.path, d.line_no, d.word, d.name,
         coalesce(min(n.line_no), max(s.n) + 1) AS next_no
  FROM marked d JOIN sizes s USING (repository_id, path)
  LEFT JOIN marked n ON n.repository_id = d.repository_id AND n.path = d.path AND n.structural
       AND n.line_no > d.line_no AND n.indent <= d.indent
  WHERE d.structural AND d.word <> '' GROUP BY ALL),
closed AS (
  SELECT e.repository_id, e.path, e.word, e.name, e.line_no AS start_line, m.last_filled AS end_line, e.next_no
  FROM ends e JOIN marked m ON m.repository_id = e.repository_id AND m.path = e.path AND m.line_no = e.next_no - 1),
spans AS (
  SELECT c.repository_id, c.path, c.name AS symbol,
         CASE WHEN c.word = 'class' THEN 'class'
              WHEN EXISTS (SELECT 1 FROM closed o WHERE o.repository_id = c.repository_id AND o.path = c.path AND o.word = 'class'
                           AND o.start_line < c.start_line AND c.start_line < o.next_no) THEN 'method' ELSE 'function' END AS kind,
         c.start_line, c.end_line
  FROM closed c
  WHERE NOT EXISTS (SELECT 1 FROM closed o WHERE o.repository_id = c.repository_id AND o.path = c.path AND o.word = 'def'
                    AND o.start_line < c.start_line AND c.start_line < o.next_no))""" + SPAN_TEXT_SQL,
)
def python_decls(spark, folder):
    return spans_out(chunking.python_decls(python_shape(spark, folder)))


@register("js_decls")
def js_decls(spark, folder):
    def shape(l, i):
        n = (i + 1).cast("string")
        c, lit = F.concat, F.lit
        return (
            F.when(i % 6 == 0, c(lit("export class C"), n, lit(" {\n  // "), l))
            .when(i % 6 == 1, c(lit("  m"), n, lit("(a) {\n    return a; // "), l, lit("\n  }")))
            .when(i % 6 == 2, c(lit("}\n// "), l))
            .when(i % 6 == 3, c(lit("function f"), n, lit("(a) {\n  // "), l, lit("\n}")))
            .when(i % 6 == 4, c(lit("const g"), n, lit(" = (a) => {\n  return a; /* "), F.replace(l, lit("*/"), lit("")), lit(" */\n};")))
            .otherwise(c(lit("// "), l))
        )

    return spans_out(chunking.js_decls(doc_text_files(spark, folder, per_line(shape))))


@register(
    "import_lines",
    r"""WITH files AS (
  SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
           CASE WHEN i % 4 IN (1, 2) THEN 'from ' || regexp_extract(lower(l), '[a-z]+') || '.m' || i || ' import ' || regexp_extract(lower(l), '[a-z]+$') ELSE l END), chr(10)) AS text
  FROM documents),""" + LINES_SQL + r""",
marked AS (
  SELECT *, line_no - row_number() OVER (PARTITION BY repository_id, path ORDER BY line_no) AS island
  FROM lines WHERE regexp_matches(line, '^\s*(?:import\s.*|from\s+\S+\s+import\s.*|export\s.*\sfrom\s+["''].*|(?:const|let|var)\s.*=\s*require\(.*)$')),
runs AS (
  SELECT repository_id, path, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS content
  FROM marked GROUP BY repository_id, path, island),
toks AS (
  SELECT repository_id, path, start_line, end_line,
         list_transform(regexp_extract_all(content, '["'']([^"'']+)["'']|(?:from|import)\s+([\p{L}\p{N}_.]+)', 0),
           lambda m: regexp_replace(m, '^(?:from|import)\s+', '')) AS tokens FROM runs)
SELECT repository_id, path, start_line, end_line, array_to_string(tokens, ' ') AS tokens,
       array_to_string(list_transform(tokens, lambda t: regexp_extract(replace(t, '.', '/'), '([^/]+)/*$', 1)), ' ') AS stems
FROM toks""",
)
def import_lines(spark, folder):
    """Two lines in four become imports; runs, their module tokens and stems."""
    def shape(l, i):
        imported = F.concat(
            F.lit("from "), F.regexp_extract(F.lower(l), "[a-z]+", 0), F.lit(".m"), (i + 1).cast("string"),
            F.lit(" import "), F.regexp_extract(F.lower(l), "[a-z]+$", 0),
        )
        return F.when((i + 1) % 4 < 3, F.when((i + 1) % 4 > 0, imported).otherwise(l)).otherwise(l)

    runs = chunking.import_lines(doc_text_files(spark, folder, per_line(shape)))
    tokens = runs.withColumn("_tokens", fx.import_tokens("content"))
    return tokens.select(
        "repository_id", "path", "start_line", "end_line", F.array_join("_tokens", " ").alias("tokens"),
        F.array_join(F.transform("_tokens", fx.module_stem), " ").alias("stems"),
    )


@register(
    "chunk_dispatch",
    f"""WITH {FILES_SQL}, typed AS (SELECT *, {LANGUAGE_SQL} AS language FROM doc_files),
files AS (SELECT source AS repository_id, path, text FROM typed WHERE language IN ('python', 'javascript', 'typescript', 'json')),""" + LINES_SQL + """,
blocks AS (
  SELECT repository_id, path, CAST(g AS INT) AS start_line, CAST(least(g + 59, n) AS INT) AS end_line
  FROM (SELECT repository_id, path, n, unnest(range(1, n + 1, 60)) AS g FROM sizes)),
whole AS (
  SELECT source AS repository_id, path, language, text,
         len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END AS n
  FROM typed WHERE language IN ('markdown', 'yaml'))
SELECT t.language, b.repository_id, b.path, 'block' AS kind, b.start_line, b.end_line,
       sha256(string_agg(l.line, chr(10) ORDER BY l.line_no)) AS content_hash
FROM blocks b JOIN typed t ON t.path = b.path
JOIN lines l ON l.repository_id = b.repository_id AND l.path = b.path AND l.line_no BETWEEN b.start_line AND b.end_line
GROUP BY ALL
UNION ALL
SELECT language, repository_id, path, CASE WHEN language = 'yaml' THEN 'file' ELSE 'section' END, 1, CAST(n AS INT), sha256(text) FROM whole""",
)
def chunk_dispatch(spark, folder):
    """Prose under every language: code and JSON fall back to windows, markdown and YAML stay whole."""
    files = documents_as_files(spark, folder).select(
        F.col("source").alias("repository_id"), "path", fx.detect_language("path").alias("language"), "text"
    ).filter(F.col("language").isNotNull())
    chunks = chunking.chunk_corpus(files)
    return chunks.select("language", "repository_id", "path", "kind", "start_line", "end_line", "content_hash")


@register(
    "chunk_rollup",
    "WITH" + DOC_CHUNKS + " SELECT repository_id, language, kind, count(*) AS chunks FROM doc_chunks GROUP BY ROLLUP (repository_id, language, kind)",
)
def chunk_rollup(spark, folder):
    return status.chunk_rollup(doc_chunks(spark, folder))


@register(
    "conversation_titles",
    """SELECT conv_id, coalesce(left(arg_min(text, turn) FILTER (WHERE role = 'user'), 60), 'New investigation') AS title
FROM conversations GROUP BY conv_id""",
)
def conversation_titles(spark, folder):
    return conversations.titles(table(spark, folder, "conversations"))
