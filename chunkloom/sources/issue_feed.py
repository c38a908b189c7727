"""Issue feeds as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions import label_names, parse_ts
from chunkloom.schemas import ISSUE_FEED


def read_issue_feed(spark: SparkSession, path: str, repository_id: str | None = None) -> DataFrame:
    """Read feed pages (many files) and keep issues only.

    The feed is read as text first: a row is a pull request when the key is *present*, and a null
    value would be lost once the row is parsed to a struct.
    """
    return parse_issue_feed(spark.read.text(path), repository_id)


def parse_issue_feed(lines: DataFrame, repository_id: str | None = None) -> DataFrame:
    raw = lines.withColumn("item", F.from_json("value", ISSUE_FEED)).filter(
        F.col("item.id").isNotNull()
        & ~F.coalesce(F.array_contains(F.json_object_keys("value"), "pull_request"), F.lit(False))
    )
    repository = F.lit(repository_id) if repository_id is not None else F.col("repository_id")
    item = F.col("item")
    return raw.select(
        repository.cast("string").alias("repository_id"),
        item["id"].alias("github_issue_id"), item["number"].alias("number"), item["title"].alias("title"),
        item["body"].alias("body"), item["user"]["login"].alias("author"),
        label_names(item["labels"]).alias("labels"), item["state"].alias("state"),
        item["html_url"].alias("html_url"),
        parse_ts(item["created_at"]).alias("github_created_at"),
        parse_ts(item["updated_at"]).alias("github_updated_at"),
        parse_ts(item["closed_at"]).alias("github_closed_at"),
    )
