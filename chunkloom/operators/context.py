"""Assembling the planning context of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions import citation
from chunkloom.functions.content import label


def _block(rows: DataFrame, line: Column, name: str) -> DataFrame:
    """Ordered lines of a run's few ranked rows (caps: 15 chunks, 20 neighbours, 5 issues, 8 commits)."""
    return rows.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_rows"),
    ).select("run_id", F.transform("_rows", lambda r: r["line"]).alias(name))


def render_context(
    runs: DataFrame, chunks: DataFrame, related: DataFrame, issues: DataFrame, commits: DataFrame
) -> DataFrame:
    """Context text per run: issue, analysis, chunks, neighbours, past issues, commits.

    ``runs``: run_id, title, body, problem, desired_behavior, requirements array<string>. Other
    inputs carry run_id and rank. A section without rows is left out, heading included, except the
    retrieved chunks' heading.
    """
    span = F.concat(F.lit("["), citation("file_path", "start_line", "end_line"), F.lit("] "), label("symbol", "kind"))
    parts = [
        _block(chunks, F.concat(span, F.lit("\n"), F.col("content"), F.lit("\n")), "_chunks"),
        _block(related, span, "_related"),
        _block(issues, F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), F.col("title"), F.lit(" ("), F.col("html_url"), F.lit(")")), "_issues"),
        _block(commits, F.concat(F.col("sha"), F.lit(" "), F.col("subject")), "_commits"),
    ]
    joined = runs
    for part in parts:
        joined = joined.join(part, "run_id", "left")
    empty = F.array().cast("array<string>")
    section = lambda heading, name: F.when(
        F.col(name).isNotNull(), F.concat(F.array(F.lit(heading)), F.col(name))
    ).otherwise(empty)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.array(
        F.concat(F.lit("# Issue: "), F.col("title")),
        text("body"),
        F.lit(""),
        F.lit("## Analysis"),
        F.concat(F.lit("Problem: "), text("problem")),
        F.concat(F.lit("Desired behavior: "), text("desired_behavior")),
        F.concat(F.lit("Requirements: "), F.array_join(F.coalesce("requirements", empty), "; ")),
        F.lit(""),
        F.lit("## Retrieved repository context"),
    )
    lines = F.concat(
        head, F.coalesce("_chunks", empty),
        section("## Related symbols (heuristic reference graph — not resolved calls)", "_related"),
        section("## Related past issues", "_issues"),
        section("## Related commit history", "_commits"),
    )
    return joined.select(
        "run_id", F.array_join(lines, "\n").alias("context"), F.coalesce(F.size("_chunks"), F.lit(0)).alias("_n"),
    ).withColumn("retrieval_count", F.greatest("_n", F.lit(0))).drop("_n")


def metrics(contexts: DataFrame) -> DataFrame:
    return contexts.select(
        "run_id", "retrieval_count", F.length("context").alias("context_chars"),
        F.floor(F.length("context") / 4).cast("long").alias("approx_tokens"),
    )
