"""Push deliveries: gate, de-duplication, repository match, outcome and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions import branch_of, signature_valid
from chunkloom.schemas import PUSH

# Supported events and outcomes.
SUPPORTED_EVENTS = ("push",)
QUEUED = "queued"
DELETED_BRANCH = "ignored_deleted_branch"
NOT_A_BRANCH = "ignored_not_a_branch"
UNKNOWN_REPOSITORY = "ignored_unknown_repository"
UNTRACKED_BRANCH = "ignored_untracked_branch"


def admit(deliveries: DataFrame, secret: str | None) -> DataFrame:
    """Add ``reject``: 401 for a bad signature, 400 for missing headers, else null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reject = F.when(~signature_valid("body", "signature", secret), 401).when(
        blank("delivery_id") | blank("event_type"), 400
    )
    return deliveries.withColumn("reject", reject)


def dedup(deliveries: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First delivery per id (by ``received_at``), ids in ``stored`` left out.

    The aggregate keeps one row per id and task before the shuffle, so an id that is repeated
    without end costs no more than any other.
    """
    fields = [c for c in deliveries.columns if c != "delivery_id"]
    rest = [f for f in fields if f != "received_at"]
    first = deliveries.groupBy("delivery_id").agg(F.min(F.struct("received_at", *rest)).alias("_row"))
    unique = first.select("delivery_id", *[F.col(f"_row.{f}").alias(f) for f in fields]).select(*deliveries.columns)
    if stored is None:
        return unique
    # The stored ids outgrow any batch: reduce them to the batch's own ids where they are read.
    asked = deliveries.select("delivery_id").distinct()
    seen = stored.select("delivery_id").join(asked, "delivery_id", "left_semi")
    return unique.join(seen, "delivery_id", "left_anti")


def parse(deliveries: DataFrame) -> DataFrame:
    """Add ``push`` from the body; null where a required field is missing. Unknown fields are dropped."""
    push = F.from_json(F.col("body").cast("string"), PUSH)
    complete = (
        F.col("_push.ref").isNotNull() & F.col("_push.before").isNotNull() & F.col("_push.after").isNotNull()
        & F.col("_push.repository.id").isNotNull() & F.col("_push.repository.full_name").isNotNull()
    )
    return deliveries.withColumn("_push", push).withColumn("push", F.when(complete, F.col("_push"))).drop("_push")


def flatten(parsed: DataFrame) -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("push", "body", "signature", "reject")]
    return parsed.filter(F.col("push").isNotNull()).select(
        *keep,
        F.col("push.ref").alias("ref"), F.col("push.before").alias("before"), F.col("push.after").alias("after"),
        F.coalesce("push.deleted", F.lit(False)).alias("deleted"),
        F.col("push.repository.id").alias("github_repo_id"), F.col("push.repository.full_name").alias("full_name"),
        F.col("push.repository.default_branch").alias("payload_branch"),
    )


def match_repository(pushes: DataFrame, repositories: DataFrame) -> DataFrame:
    """Repository of a push: by numeric id, else by name without case.

    Works on a stream: both sides of the lookup are static and the joins are left joins.
    """
    by_id = (
        repositories.filter(F.col("github_repo_id").isNotNull()).select(
            "github_repo_id", F.struct("repository_id", "default_branch").alias("_by_id"))
    )
    by_name = (
        repositories.filter(F.col("full_name").isNotNull()).groupBy(F.lower("full_name").alias("_name")).agg(
            F.min(F.struct("repository_id", "default_branch")).alias("_by_name"))
    )
    hit = F.coalesce("_by_id", "_by_name")
    return (
        pushes.withColumn("_name", F.lower("full_name"))
        .join(by_id, "github_repo_id", "left").join(by_name, "_name", "left")
        .withColumn("repository_id", hit["repository_id"]).withColumn("default_branch", hit["default_branch"])
        .drop("_by_id", "_by_name", "_name")
    )


def _outcome(tracked: Column) -> Column:
    return (
        F.when(F.col("deleted"), DELETED_BRANCH)
        .when(branch_of("ref").isNull(), NOT_A_BRANCH)
        .when(F.col("repository_id").isNull(), UNKNOWN_REPOSITORY)
        .when(F.coalesce(branch_of("ref") != tracked, F.lit(False)), UNTRACKED_BRANCH)
        .otherwise(QUEUED)
    )


def outcomes(matched: DataFrame) -> DataFrame:
    """Outcome against the stored branch, else the payload's own; row by row, also on a stream."""
    tracked = F.coalesce(F.nullif("default_branch", F.lit("")), "payload_branch")
    return matched.withColumn("outcome", _outcome(tracked))


def outcomes_in_order(matched: DataFrame) -> DataFrame:
    """Outcomes of a batch in delivery order.

    A repository without a stored branch takes the one of its first push to its own default branch;
    later pushes are held against that. The first such push is an aggregate per repository.
    """
    opens = (
        F.col("repository_id").isNotNull() & (F.coalesce("default_branch", F.lit("")) == "") & ~F.col("deleted")
        & (branch_of("ref") == F.col("payload_branch"))
    )
    at = F.struct("received_at", "delivery_id")
    first = (
        matched.filter(opens).groupBy("repository_id").agg(F.min(F.struct("received_at", "delivery_id", "payload_branch")).alias("_first"))
    )
    learned = F.when(
        at > F.struct(F.col("_first.received_at").alias("received_at"), F.col("_first.delivery_id").alias("delivery_id")),
        F.col("_first.payload_branch"),
    )
    tracked = F.coalesce(F.nullif("default_branch", F.lit("")), learned, "payload_branch")
    return matched.join(first, "repository_id", "left").withColumn("outcome", _outcome(tracked)).drop("_first")


def backfill(repositories: DataFrame, decided: DataFrame) -> DataFrame:
    """Fill missing id, name and branch of repositories from their first deciding push."""
    seen = decided.filter(F.col("repository_id").isNotNull() & F.col("outcome").isin(QUEUED, UNTRACKED_BRANCH))
    at = F.struct("received_at", "delivery_id")
    first = seen.groupBy("repository_id").agg(
        F.min_by("github_repo_id", at).alias("_id"), F.min_by("full_name", at).alias("_full_name"),
        F.min_by(
            F.col("payload_branch"),
            F.when((F.col("outcome") == QUEUED) & F.col("payload_branch").isNotNull(), at),
        ).alias("_branch"),
    )
    columns = repositories.columns
    return (
        repositories.join(first, "repository_id", "left")
        .withColumn("github_repo_id", F.coalesce("github_repo_id", "_id"))
        .withColumn("full_name", F.coalesce("full_name", "_full_name"))
        .withColumn("default_branch", F.coalesce("default_branch", "_branch"))
        .select(*columns)
    )


def gate(
    deliveries: DataFrame, secret: str | None, repositories: DataFrame, stored: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run deliveries through every check in order; (accepted with status and outcome, rejected).

    Signature, headers, de-duplication, event type, body, outcome. Ignored outcomes are marked
    ``ignored``; a malformed body is ``failed``.
    """
    admitted = admit(deliveries, secret)
    rejected = admitted.filter(F.col("reject").isNotNull()).select("delivery_id", "event_type", "received_at", "reject")
    first = parse(dedup(admitted.filter(F.col("reject").isNull()).drop("reject", "signature"), stored))
    supported = F.col("event_type").isin(*SUPPORTED_EVENTS)
    pushes = outcomes_in_order(match_repository(flatten(first.filter(supported)), repositories))
    columns = ["delivery_id", "event_type", "received_at", "repository_id", "github_repo_id", "full_name",
               "payload_branch", "before", "after", "outcome"]
    status = F.when(F.col("outcome") == QUEUED, "queued").otherwise("ignored")
    decided = pushes.select(*columns, status.alias("status"))
    aside = first.filter(~supported | F.col("push").isNull()).select(
        "delivery_id", "event_type", "received_at",
        F.when(~F.col("event_type").isin(*SUPPORTED_EVENTS), "ignored").otherwise("failed").alias("status"),
    )
    return decided.unionByName(aside, allowMissingColumns=True), rejected


def hourly(deliveries: DataFrame, width: str = "1 hour") -> DataFrame:
    """Deliveries per time window and status; on a stream give it a watermark first."""
    return deliveries.groupBy(F.window("received_at", width), "status").agg(F.count(F.lit(1)).alias("deliveries")).select(
        F.col("window.start").alias("window_start"), "status", "deliveries"
    )


def newest_push(decided: DataFrame) -> DataFrame:
    """Latest queued push per repository."""
    return decided.filter(F.col("outcome") == QUEUED).groupBy("repository_id").agg(
        F.max_by("after", F.struct("received_at", "delivery_id")).alias("after")
    )
