"""Comparing two snapshots of many repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.functions import NONBLANK
from chunkloom.operators.chunking import with_lines
from chunkloom.operators.skew import group_rank
from chunkloom.session import cut

KEY = ["repository_id", "path"]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """new / changed / unchanged / deleted per path, by content hash."""
    o = old.select(*KEY, F.col("content_hash").alias("old_hash"))
    n = new.select(*KEY, F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return o.join(n, KEY, "full_outer").withColumn("status", status)


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that are indexed but no longer tracked."""
    return old.select(*KEY).join(new.select(*KEY), KEY, "left_anti")


def pair_renames(changes: DataFrame) -> DataFrame:
    """Exact renames: the i-th deleted path pairs with the i-th new path of equal content.

    Numbering is by :func:`group_rank`, so one content hash may hold any share of the files.
    """
    gone = group_rank(
        changes.filter(F.col("status") == "deleted").select(
            "repository_id", F.col("old_hash").alias("content_hash"), F.col("path").alias("old_path")
        ),
        ["repository_id", "content_hash"], "old_path", "pair_no",
    )
    came = group_rank(
        changes.filter(F.col("status") == "new").select(
            "repository_id", F.col("new_hash").alias("content_hash"), "path"
        ),
        ["repository_id", "content_hash"], "path", "pair_no",
    )
    return gone.join(came, ["repository_id", "content_hash", "pair_no"]).drop("pair_no")


def _line_sets(files: DataFrame) -> DataFrame:
    """Distinct non-blank lines per file; files with equal sets are kept once, by smallest path.

    Under mutual-best pairing only the smallest path of such a class can be in a pair, so the
    result is unchanged while a group of copies shrinks to one row.
    """
    sets = (
        with_lines(files.select(*KEY, "text"))
        .select(
            *KEY,
            F.array_sort(
                F.array_distinct(F.transform(F.filter("lines", lambda l: l.rlike(NONBLANK)), lambda l: F.md5(l)))
            ).alias("line_set"),
        )
        .filter(F.size("line_set") > 0)
        .withColumn("set_hash", F.sha2(F.array_join("line_set", ""), 256))
    )
    return sets.groupBy("repository_id", "set_hash").agg(
        F.min("path").alias("path"), F.any_value("line_set").alias("line_set")
    ).drop("set_hash").withColumn("n", F.size("line_set"))


def _scored_sets(old: DataFrame, new: DataFrame, min_ratio: float) -> DataFrame:
    """(repository_id, old_path, path, ratio): line sets of two sides with Jaccard ≥ ``min_ratio``, by an exact prefix filter."""
    tagged = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    exploded = tagged.select("side", *KEY, "n", F.explode("line_set").alias("line"))
    frequency = exploded.groupBy("repository_id", "line").agg(F.count(F.lit(1)).alias("freq"))
    rarest = Window.partitionBy("side", *KEY).orderBy("freq", "line")
    prefix = (
        exploded.join(frequency, ["repository_id", "line"])
        .withColumn("pos", F.row_number().over(rarest))
        .filter(F.col("pos") <= F.col("n") - F.ceil(F.lit(min_ratio) * F.col("n")) + 1)
    )
    left = prefix.filter("side = 'old'").select("repository_id", "line", F.col("path").alias("old_path"), F.col("n").alias("old_n"))
    right = prefix.filter("side = 'new'").select("repository_id", "line", "path", "n")
    candidates = (
        left.join(right, ["repository_id", "line"])
        .filter(F.least("n", "old_n") >= F.lit(min_ratio) * F.greatest("n", "old_n"))
        .select("repository_id", "old_path", "path").distinct()
    )
    return (
        candidates.join(old.select("repository_id", F.col("path").alias("old_path"), F.col("line_set").alias("old_set")), ["repository_id", "old_path"])
        .join(new.select(*KEY, "line_set"), KEY)
        .withColumn("shared", F.size(F.array_intersect("old_set", "line_set")))
        .withColumn("ratio", F.col("shared") / (F.size("old_set") + F.size("line_set") - F.col("shared")))
        .filter(F.col("ratio") >= min_ratio)
        .select("repository_id", "old_path", "path", "ratio")
    )


def pair_similar_renames(gone: DataFrame, came: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Renames with edits: deleted and new files whose line sets have Jaccard ≥ ``min_ratio``.

    Candidates come from a prefix filter: two sets that reach the ratio must share a line among the
    rarest ``n - ceil(ratio * n) + 1`` lines of each, so common lines (braces, licence headers)
    are never joined on. The filter loses no pair. Mutual best matches are kept.
    """
    old, new = _line_sets(gone), _line_sets(came)
    scored = _scored_sets(old, new, min_ratio)
    best_new = Window.partitionBy("repository_id", "old_path").orderBy(F.desc("ratio"), "path")
    best_old = Window.partitionBy(*KEY).orderBy(F.desc("ratio"), "old_path")
    for_old = scored.withColumn("_r", F.row_number().over(best_new)).filter("_r = 1").drop("_r")
    for_new = scored.withColumn("_r", F.row_number().over(best_old)).filter("_r = 1").select("repository_id", "old_path", "path")
    return for_old.join(for_new, ["repository_id", "old_path", "path"])


def _classed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of files with equal line sets, each with its size, and the files with the number they have in their class.

    A class goes by its smallest path.
    """
    sets = cut(
        with_lines(files.select(*KEY, "text"))
        .select(*KEY, F.array_sort(F.array_distinct(
            F.transform(F.filter("lines", lambda l: l.rlike(NONBLANK)), lambda l: F.md5(l)))).alias("line_set"))
        .filter(F.size("line_set") > 0)
        .withColumn("set_hash", F.sha2(F.array_join("line_set", ""), 256))
    )
    classes = sets.groupBy("repository_id", "set_hash").agg(
        F.min("path").alias("path"), F.any_value("line_set").alias("line_set"), F.count(F.lit(1)).alias("members")
    ).withColumn("n", F.size("line_set"))
    numbered = group_rank(sets.select(*KEY, "set_hash"), ["repository_id", "set_hash"], "path", "number")
    return cut(classes), numbered


def match_similar_renames(gone: DataFrame, came: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """(repository_id, old_path, path, ratio): edited moves, paired until no pair of files with Jaccard ≥ ``min_ratio`` is left open.

    The pairs are those of taking all candidates by falling ratio, equal ratios by the MD5 of their paths, and keeping
    each whose two files are still free. Instead of that one order, every round takes all pairs that are the best open
    one of both their ends; a hashed order of ties makes the number of rounds grow with the logarithm of the files.
    Files with equal line sets are one class that is matched as often as it has members, so a large group of copies is
    one row in the rounds. Files without a non-blank line match nothing; ``gone`` and ``came`` are (repository_id, path, text).
    """
    (old, old_files), (new, new_files) = _classed(gone), _classed(came)
    tie = F.md5(F.concat_ws("\x1f", "old_path", "path"))
    open_pairs = cut(
        _scored_sets(old, new, min_ratio).withColumn("rank", F.struct((-F.col("ratio")).alias("r"), tie.alias("t")))
        .join(old.select("repository_id", F.col("path").alias("old_path"), F.col("members").alias("old_free")), ["repository_id", "old_path"])
        .join(new.select(*KEY, F.col("members").alias("free")), KEY)
        .withColumn("old_used", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
    )
    taken = []
    while not open_pairs.isEmpty():
        best_old = open_pairs.groupBy("repository_id", "old_path").agg(F.min_by("path", "rank").alias("path"))
        best_new = open_pairs.groupBy(*KEY).agg(F.min_by("old_path", "rank").alias("old_path"))
        mutual = best_old.join(best_new, ["repository_id", "old_path", "path"])
        now = cut(open_pairs.join(mutual, ["repository_id", "old_path", "path"]).withColumn("k", F.least("old_free", "free")))
        taken.append(now.select("repository_id", "old_path", "path", "ratio", "k", "old_used", "used"))
        left = (
            open_pairs.join(now.select("repository_id", "old_path", F.col("k").alias("_ko")), ["repository_id", "old_path"], "left")
            .join(now.select(*KEY, F.col("k").alias("_kn")), KEY, "left")
        )
        spent_old, spent_new = F.coalesce("_ko", F.lit(0)), F.coalesce("_kn", F.lit(0))
        open_pairs = cut(
            left.withColumn("old_free", F.col("old_free") - spent_old).withColumn("free", F.col("free") - spent_new)
            .withColumn("old_used", F.col("old_used") + spent_old).withColumn("used", F.col("used") + spent_new)
            .filter("old_free > 0 AND free > 0").drop("_ko", "_kn")
        )
    none = "repository_id string, old_path string, path string, ratio double, k long, old_used long, used long"
    matches = reduce(DataFrame.unionByName, taken) if taken else old.sparkSession.createDataFrame([], none)

    def drawn(files: DataFrame, classes: DataFrame, side: str, used: str) -> DataFrame:
        """Members of the matched classes, numbered from 1 within each match."""
        named = files.join(classes.select("repository_id", "set_hash", F.col("path").alias(side)), ["repository_id", "set_hash"])
        part = matches.select("repository_id", "old_path", F.col("path").alias("new_path"), "ratio", "k", F.col(used).alias("_from"))
        return named.join(part, ["repository_id", side]).filter("number > _from AND number <= _from + k").select(
            "repository_id", "old_path", "new_path", "ratio", (F.col("number") - F.col("_from")).alias("pair_no"), F.col("path").alias("_member")
        )

    pairs = drawn(old_files, old, "old_path", "old_used").withColumnRenamed("_member", "_old").join(
        drawn(new_files, new, "new_path", "used"), ["repository_id", "old_path", "new_path", "ratio", "pair_no"]
    )
    return pairs.select("repository_id", F.col("_old").alias("old_path"), F.col("_member").alias("path"), "ratio")


def name_status(changes: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """Diff entries (status, path, old_path) from a snapshot comparison and its rename pairs."""
    base = changes.filter(F.col("status") != "unchanged").select(
        "repository_id",
        F.when(F.col("status") == "new", "added").when(F.col("status") == "changed", "modified")
        .otherwise("deleted").alias("status"),
        "path",
    ).withColumn("old_path", F.lit(None).cast("string"))
    if renames is None:
        return base
    left_out = renames.select("repository_id", F.col("old_path").alias("path"), F.lit("deleted").alias("status")).unionByName(
        renames.select("repository_id", "path", F.lit("added").alias("status"))
    )
    moved = renames.select("repository_id", F.lit("renamed").alias("status"), "path", "old_path")
    return base.join(left_out, ["repository_id", "path", "status"], "left_anti").select(
        "repository_id", "status", "path", "old_path"
    ).unionByName(moved)
