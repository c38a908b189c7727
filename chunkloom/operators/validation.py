"""Checking plans against what was retrieved and indexed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from chunkloom.schemas import INVALID_PLAN_CONFIDENCE

NO_PLAN = "No implementation plan was generated."


def _quote(c):
    return F.concat(F.lit("'"), F.col(c), F.lit("'"))


def validate_citations(plans: DataFrame, paths: DataFrame) -> DataFrame:
    """Cited paths that were neither retrieved nor related. ``paths``: run_id, file_path."""
    cited = plans.select("run_id", F.posexplode("plan.citations").alias("pos", "c")).select(
        "run_id", "pos", F.col("c.file_path").alias("file_path")
    )
    return cited.join(paths.select("run_id", "file_path").distinct(), ["run_id", "file_path"], "left_anti").select(
        "run_id", F.lit(1).alias("rule"), F.col("pos").alias("i"), F.lit(0).alias("j"),
        F.concat(F.lit("Citation references "), _quote("file_path"), F.lit(", which was never retrieved.")).alias("error"),
    )


def validate_affected_files(plans: DataFrame, files: DataFrame) -> DataFrame:
    named = plans.select("run_id", "repository_id", F.posexplode("plan.affected_files").alias("pos", "path"))
    return named.join(files.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_anti").select(
        "run_id", F.lit(2).alias("rule"), F.col("pos").alias("i"), F.lit(0).alias("j"),
        F.concat(F.lit("affected_files references "), _quote("path"), F.lit(", not found in the repo.")).alias("error"),
    )


def validate_steps(plans: DataFrame) -> DataFrame:
    """Steps that depend on a missing step or on one that is not earlier; decided inside the plan row."""
    numbers = F.transform("plan.implementation_steps", lambda s: s["step_number"])
    steps = plans.select("run_id", numbers.alias("numbers"), F.posexplode("plan.implementation_steps").alias("pos", "step"))
    needs = steps.select("run_id", "numbers", "pos", F.col("step.step_number").alias("n"), F.posexplode("step.depends_on_steps").alias("j", "dep"))
    return needs.filter(~F.array_contains("numbers", F.col("dep")) | (F.col("dep") >= F.col("n"))).select(
        "run_id", F.lit(3).alias("rule"), F.col("pos").alias("i"), "j",
        F.concat(F.lit("Step "), F.col("n").cast("string"), F.lit(" depends_on_steps references invalid step "), F.col("dep").cast("string"), F.lit(".")).alias("error"),
    )


def validate(plans: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """Errors per plan in rule order, and the confidence, at most 0.4 where there is any error.

    ``plans``: run_id, repository_id, plan. The error list is bounded by the size of the plan.
    """
    missing = plans.filter(F.col("plan").isNull()).select(
        "run_id", F.lit(0).alias("rule"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(NO_PLAN).alias("error")
    )
    errors = reduce(
        DataFrame.unionByName,
        [missing, validate_citations(plans, paths), validate_affected_files(plans, files), validate_steps(plans)],
    )
    collected = errors.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rule", "i", "j", "error"))).alias("_e"))
    listed = F.transform("_e", lambda e: e["error"])
    confidence = F.coalesce(F.col("plan.confidence"), F.lit(0.5))
    return plans.join(collected, "run_id", "left").select(
        "run_id", "repository_id",
        F.coalesce(listed, F.array().cast("array<string>")).alias("validation_errors"),
        F.when(F.col("_e").isNull(), confidence).otherwise(F.least(confidence, F.lit(INVALID_PLAN_CONFIDENCE))).alias("confidence"),
    )
