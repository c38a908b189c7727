"""Planning context for many runs, offline defaults, validation and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.functions import NONBLANK
from chunkloom.operators import context, evaluation, graph, history, validation
from chunkloom.operators.chunking import with_lines
from chunkloom.plans.retrieval import hybrid_search
from chunkloom.session import cut
from chunkloom.schemas import PLAN, PLANNING_CHUNKS, PLANNING_TOP_K


def default_queries(prompts: DataFrame, characters: int = 200) -> DataFrame:
    """One query per prompt: its first non-blank line, trimmed, at most ``characters`` characters."""
    filled = F.filter("lines", lambda l: l.rlike(NONBLANK))
    first = F.regexp_replace(F.get(filled, F.lit(0)), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    keep = [c for c in prompts.columns if c != "text"]
    return with_lines(prompts).select(*keep, F.substring(F.coalesce(first, F.lit("issue")), 1, characters).alias("query"))


def default_plans(runs: DataFrame) -> DataFrame:
    """Low-confidence plan that claims nothing, for runs without a planning model."""
    empty = "named_struct('citations', array(), 'affected_files', array(), 'implementation_steps', array(), 'confidence', 0.1D)"
    return runs.withColumn("plan", F.expr(empty).cast(PLAN))


def retrieve(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, rank_by: str = "score", k: int = PLANNING_CHUNKS, per_query: int = PLANNING_TOP_K,
    **options,
) -> DataFrame:
    """Best ``k`` chunks per run over all its queries.

    ``queries``: run_id, query_no, repository_id, query_id, query, embedding. A chunk found by several
    queries keeps its best score, the lowest query number on a tie. ``rank_by`` is ``score`` (the
    mixed value searches report) or ``fused_score``.
    """
    hits = hybrid_search(queries, chunks, vectors, top_k=per_query, **options)
    asked = queries.select("query_id", "run_id", "query_no")
    fields = ["file_path", "language", "symbol", "kind", "start_line", "end_line", "content", "score", "fused_score"]
    best = hits.join(asked, "query_id").groupBy("run_id", "repository_id", "chunk_id").agg(
        F.max_by(F.struct("query_no", *fields), F.struct(rank_by, -F.col("query_no"))).alias("_best")
    ).select("run_id", "repository_id", "chunk_id", "_best.*")
    order = Window.partitionBy("run_id").orderBy(F.desc(rank_by), "query_no", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def related_files(retrieved: DataFrame) -> DataFrame:
    """Sorted distinct paths of the retrieved chunks, at most 15 a run."""
    return retrieved.groupBy("run_id").agg(F.array_sort(F.collect_set("file_path")).alias("related_files"))


def planning_context(
    runs: DataFrame, queries: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame],
    issues: DataFrame, commits: DataFrame, **options,
) -> dict[str, DataFrame]:
    """Retrieved chunks, neighbours, history and the rendered context of every run.

    ``runs`` as in :func:`context.render_context`; ``queries`` as in :func:`retrieve` plus
    issue_number; ``edges`` is a stored table, or a function like :func:`graph.references_near` gives.
    """
    retrieved = cut(retrieve(queries, chunks, vectors, **options))  # 15 rows a run, read three times
    seeds = retrieved.select(F.col("run_id").alias("set_id"), "repository_id", "chunk_id")
    related = cut(graph.neighbours(seeds, edges(seeds) if callable(edges) else edges, chunks).withColumnRenamed("set_id", "run_id"))
    past = history.related_issues(queries, issues)
    log = history.related_commits(queries, commits)
    rendered = context.render_context(runs, retrieved, related, past, log)
    return {
        "retrieved": retrieved, "related": related, "issues": past, "commits": log,
        "context": rendered, "metrics": context.metrics(rendered),
    }


def validate_and_evaluate(
    plans: DataFrame, retrieved: DataFrame, related: DataFrame, files: DataFrame, expected: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Validation per plan and, with expected files per run, the evaluation report."""
    paths = retrieved.select("run_id", "file_path").unionByName(related.select("run_id", "file_path")).distinct()
    out = {"validation": validation.validate(plans, paths, files)}
    if expected is not None:
        seen = retrieved.groupBy("run_id").agg(F.collect_set("file_path").alias("retrieved"))
        cases = plans.join(expected, "run_id").join(seen, "run_id", "left").select(
            F.col("run_id").alias("case_id"), "expected",
            F.coalesce("plan.affected_files", F.array().cast("array<string>")).alias("predicted"),
            F.coalesce(F.transform("plan.citations", lambda c: c["file_path"]), F.array().cast("array<string>")).alias("cited"),
            F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"),
        )
        out["cases"] = evaluation.plan_cases(cases)
        out["summary"] = evaluation.plan_summary(out["cases"])
    return out
