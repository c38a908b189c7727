"""Registered queries of this subpackage, each with its SQL check where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.llm import decontam, dualtree, filteraudit, lm, mixing, neardup, ngramjoin, pii, quality, secrets, tokencount, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


@register("op1_warc")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every crawled page."""
    return warc.derivatives(warc.responses_of(table(spark, folder, "pages")), ["page_id"])


ALNUM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op2_decontam", f"""
WITH texts AS (SELECT doc_id, {ALNUM_WORDS.format(LOWER.format('coalesce(text, $$$$)'))} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS.format(LOWER.format('text'))} AS w FROM benchmark),
sizes AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sizes)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, lengths WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)""")
def op2_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in passages of benchmark items."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = decontam.contamination(table(spark, folder, "documents"), items)
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")


# Fixed rules of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@register("op3_urlfilter", """
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + """),
fits AS (
  SELECT DISTINCT host, path, h || p AS rule, v FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) AS k FROM fits QUALIFY k = 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (host, path)""")
def op3_urlfilter(spark: SparkSession, folder: str) -> DataFrame:
    """Winning rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, folder, "pages"), rules)


@register("op4_neardup", f"""
WITH RECURSIVE texts AS (SELECT doc_id, {SPACE_WORDS.format(LOWER.format('coalesce(text, $$$$)'))} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM texts),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT m.a, m.b FROM met m JOIN sets x ON x.doc_id = m.a JOIN sets y ON y.doc_id = m.b
  WHERE 100 * m.n >= 75 * (len(x.s) + len(y.s) - m.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT w.b, p.r FROM reach p JOIN both_ways w ON w.a = p.doc_id WHERE p.r < w.b),
least_id AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least_id l USING (doc_id)""")
def op4_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


@register("op5_lm")
def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.score(table(spark, folder, "documents"))


@register("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes from every document."""
    return mixing.mix(table(spark, folder, "documents"))


@register("op7_secrets")
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, folder, "documents"), ["doc_id"])


@register("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures, log-likelihood ratio and verdict of every document."""
    docs = table(spark, folder, "documents")
    trusted = quality.trusted_ids(table(spark, folder, "labels"))
    return quality.measure(docs, quality.fit(docs, trusted), trusted, ["doc_id"])


@register("op9_pii")
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    return pii.anonymise(table(spark, folder, "documents"), ["doc_id"], pii.key_of(spark))


@register("op10_tokens")
def op10_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document."""
    import public_tokenizers

    return tokencount.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op11_filters", f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, {SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM texts),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, f),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s:s] AS own, filter_order[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
judged AS (
  SELECT *, contains(f, own) AS fails, length(translate(f, before, '')) < length(f) AS gone FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (f = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed""")
def op11_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every step of every order of five filters, by language."""
    return filteraudit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op12_ngramjoin", f"""
WITH RECURSIVE texts AS (SELECT doc_id, {SPACE_WORDS.format(LOWER.format('coalesce(text, $$$$)'))} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s
  FROM texts),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b
  ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
links AS (
  SELECT m.a, m.b FROM met m JOIN sets x ON x.doc_id = m.a JOIN sets y ON y.doc_id = m.b
  WHERE 100 * m.n >= 90 * (len(x.s) + len(y.s) - m.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT w.b, p.r FROM reach p JOIN both_ways w ON w.a = p.doc_id WHERE p.r < w.b),
least_id AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id FROM sets s JOIN least_id l USING (doc_id)""")
def op12_ngramjoin(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document in the Jaccard join on three-word shingles."""
    return ngramjoin.linked(table(spark, folder, "documents"))


RANK_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op13_search", f"""
WITH texts AS (SELECT doc_id, unnest({RANK_TERMS.format("coalesce(text, '')")}) AS word FROM documents),
tf AS (SELECT doc_id, {LOWER.format('word')} AS term, count(*) AS tf FROM texts GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (SELECT DISTINCT item_id, {LOWER.format('word')} AS term FROM (SELECT item_id, unnest({RANK_TERMS.format('text')}) AS word FROM benchmark)),
weights AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM wanted JOIN df USING (term), total),
lengths AS (SELECT doc_id, 50 + (50 * n * docs) // len AS m FROM sizes, total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM weights JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50""")
def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return dualtree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
