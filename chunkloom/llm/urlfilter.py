"""URL rules over host suffixes and path prefixes, found by short hash prefixes.

Every distinct (host, path) is expanded into expressions: each host suffix on a label boundary joined to each path
prefix. Only suffixes of as many labels, and prefixes of such lengths, as some rule has are made, so an expansion is
bounded by the rules and not by the URL. Expressions meet rules in an equi-join on the first four bytes of their
SHA-256; the few that meet confirm the full digest. Of the rules that fit, the longest wins; of equal rules, block.
Rules are joined by whatever way Spark chooses from their size, so a list of any length works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.llm.words import lower_ascii

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digest(expression: str) -> Column:
    return F.sha2(F.col(expression).cast("binary"), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """(rule, verdict, prefix, digest) of distinct rules (host, path, verdict); rules without host are ignored."""
    named = rules.filter("host IS NOT NULL AND host <> ''").select(
        F.concat(lower_ascii("host"), F.coalesce("path", F.lit(""))).alias("rule"),
        F.when(F.lower("verdict") == "block", F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
    return named.groupBy("rule").agg(F.max("verdict").alias("verdict")).withColumn("digest", _digest("rule")).withColumn("prefix", F.substring("digest", 1, 8))


def expressions(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(host, path, expression) for suffixes of up to ``labels`` labels and path prefixes of the given lengths."""
    suffixes = F.expr(
        f"transform(sequence(1, least(size(split(host, '[.]')), {labels})), i -> substring_index(host, '.', -i))"
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    both = F.flatten(F.transform("_suffixes", lambda s: F.transform("_prefixes", lambda p: F.concat(s, p))))
    return (
        urls.withColumn("_suffixes", F.array_distinct(suffixes)).withColumn("_prefixes", prefixes)
        .select("host", "path", F.explode(both).alias("expression"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, the winning ``rule`` and its ``verdict``.

    A null url, or one without ``://``, has an empty host and path and gets ``default``, as does a url that no rule
    fits (``rule`` is null). Repeated rows are judged alike, and each is returned. Other columns are not read.
    """
    listed = prepared(rules)
    sizes = rules.filter("host IS NOT NULL AND host <> ''").agg(
        F.max(F.size(F.split("host", "[.]"))).alias("labels"),
        F.sort_array(F.collect_set(F.length(F.coalesce("path", F.lit(""))))).alias("lengths"),  # as many as the longest path has characters
    ).first()
    parted = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if sizes["labels"] is None:
        return parted.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    urls = parted.filter("host <> ''").select("host", "path").distinct()
    expanded = expressions(urls, sizes["labels"], sizes["lengths"]).withColumn("prefix", F.substring(_digest("expression"), 1, 8))
    met = expanded.join(listed, "prefix").filter(_digest("expression") == F.col("digest"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return (
        parted.join(best, ["host", "path"], "left")
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
