"""File snapshots: from a directory tree or from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_snapshot(
    spark: SparkSession, root: str, repository_id: str, glob: str | None = None, commit: str | None = None
) -> DataFrame:
    """Files under ``root`` as ``files`` rows with repo-relative paths.

    ``root`` must hold tracked files only. A filter on ``length`` or the path is applied by the
    source before bytes are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    full = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*", "/")
    return reader.load(root).select(
        F.lit(repository_id).alias("repository_id"),
        F.lit(commit).cast("string").alias("commit"),
        F.substring(full, F.locate(base, full) + len(base), F.length(full)).alias("path"),
        "length",
        "content",
    )


def files_from_table(
    df: DataFrame, repo_col: str, path_col: str, text_col: str, commit: str | None = None
) -> DataFrame:
    """Project a corpus table to the ``files`` schema."""
    content = F.col(text_col).cast("binary")
    return df.select(
        F.col(repo_col).cast("string").alias("repository_id"),
        F.lit(commit).cast("string").alias("commit"),
        F.col(path_col).alias("path"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
    )
