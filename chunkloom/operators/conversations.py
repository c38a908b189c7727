"""Chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def titles(messages: DataFrame, default: str = "New investigation") -> DataFrame:
    """Title of a conversation: first 60 characters of its first user message.

    The aggregate picks the turn that decides, not the text of every turn.
    """
    user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.substring("text", 1, 60)), F.when(user, F.col("turn"))).alias("_title")
    ).select("conv_id", F.coalesce("_title", F.lit(default)).alias("title"))
