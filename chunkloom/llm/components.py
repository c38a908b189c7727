"""Connected components of a distributed link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chunkloom.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns ``a``, ``b``); component is the smallest node reachable.

    Each round points every node at its smallest neighbour, shortens the pointers once, and replaces both ends of
    each link by what they point at. The smallest node of a component always points at itself, so it is what
    remains. Rounds grow with the logarithm of a component's diameter; each is two aggregations and joins over
    the links that are left, written to the shared folder. Nothing is collected; a node with very many links is
    only ever an aggregation key.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent"))
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        pointed = cut(parents.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")))
        rounds.append(pointed)
        left = pointed.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = pointed.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        edges = cut(
            edges.join(left, "a").join(right, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct()
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = rounds[0].select("node", F.col("parent").alias("component"))
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("component"), "parent")
        found = found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return found
