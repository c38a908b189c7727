"""Near-duplicate classes by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles as 64-bit hashes; its sketch is the ``K`` smallest of them.

1. Equal sets form one class; the smallest doc_id stands for it.
2. Inverted lists of retained values generate overlaps. A pair at the wanted similarity shares at least ``SHARED``
   of the values of its sketches (a short set shares three quarters of its values), so it meets in a list of one of
   the values that come first when each sketch is ordered by list length. Values that occur in one sketch only are
   counted and dropped, values of frequent passages come last and are hardly ever looked at.
3. In each list every member is paired with the list's most central member, the one whose values are shared most.
   The union sketch (the ``K`` smallest values of both sketches) estimates the similarity and filters the pairs; the
   best pair of each member is verified on full sets, and the verified links are joined to components.
4. Lists whose members are all in one component are done. For the members of the others the same prefix filter runs
   once more, exactly and on full sets: a shingle that only one component has can't be part of a missing link, so a
   document with over a quarter of such shingles is out. Pairs meet in the short lists of rare shingles, or else
   have three quarters of their shingles among the frequent ones. What can still be similar is verified on full sets.

The work of step 4 follows the pairs that are truly undecided, not the square of a group of copies. A link is lost
only if the sketches of a pair at similarity 0.75 share under ``SHARED`` of ``K`` values: below 1e-7 a pair by the
binomial tail; sets of up to ``K`` shingles are compared by their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.llm import words as W
from chunkloom.llm.components import components
from chunkloom.session import cut

SHINGLE = 5
K = 96
SHARED = 48
RARE = 8        # documents that have a rare shingle


def shingle_set(codes_hashed: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes as signed 64-bit numbers."""
    return np.unique(W.rolled(codes_hashed, size).view(np.int64))


def _sets(batches, most: int | None):
    for batch in batches:
        ids, texts = batch.column(0), W.binary_column(batch, "text")
        for a, b in W.groups(texts):
            codes, lengths, vocabulary = W.coded([W.space_words(t) for t in texts[a:b]])
            hashed = W.hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
            stops = np.cumsum(lengths)
            sets = [shingle_set(hashed[e - n: e]) for e, n in zip(stops, lengths)]
            sizes = np.fromiter(map(len, sets), np.int64, b - a)
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            shown = [s[:most] for s in sets]
            flat = np.concatenate(shown) if shown else np.zeros(0, np.int64)
            ends = np.cumsum([len(s) for s in shown])
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [ids[a:b], pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), values],
                ["doc_id", "n_shingles", "h1", "h2", "values"],
            )


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))


SETS = "doc_id long, n_shingles long, h1 long, h2 long, values array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, values): set size, 128-bit key of the set, and its K smallest hashes in order."""
    return _source(docs).mapInArrow(W.tidy(lambda it: _sets(it, K)), SETS)


def full_sets(docs: DataFrame) -> DataFrame:
    """As :func:`sketches`, but ``values`` is the whole sorted set."""
    return _source(docs).mapInArrow(W.tidy(lambda it: _sets(it, None)), SETS)


def _of_nodes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that stand for their class, once each."""
    chosen = classes.select("h1", "h2", F.col("node").alias("doc_id"))
    return sets.join(chosen, ["h1", "h2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "values").distinct()


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """(value, node, n, rank): the values of each sketch that must be looked at, rarest first.

    Sketches of s values that share m values share one of the first s - m + 1 in any common order. ``rank`` tells how
    much the values of a sketch are shared on the whole.
    """
    postings = nodes.select("node", F.explode("values").alias("value"))
    lengths = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need = F.least(F.lit(SHARED), F.ceil(F.col("s") * 0.75).cast("int"))
    sizes = nodes.select("node", F.col("n_shingles").alias("n"), F.size("values").alias("s"))
    by_node = (
        postings.join(lengths, "value")
        .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
        .join(sizes, "node")
        .withColumn("take", F.col("s") - need + 1 - (F.col("s") - F.size("shared")))
        .filter("take > 0")
        .withColumn("rank", F.aggregate("shared", F.lit(0.0), lambda t, x: t + F.log(x["df"].cast("double"))))
    )
    return by_node.select("node", "n", "rank", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("x")).select(
        F.col("x.value").alias("value"), "node", "n", "rank"
    )


def _near(a: str, b: str):
    """Set sizes that allow the similarity."""
    return (4 * F.col(a) >= 3 * F.col(b)) & (4 * F.col(b) >= 3 * F.col(a))


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) that the union sketch allows, with ``estimate``, the shared part of the union sketch."""
    left = nodes.select(F.col("node").alias("a"), F.col("values").alias("va"))
    right = nodes.select(F.col("node").alias("b"), F.col("values").alias("vb"))
    union = F.slice(F.array_sort(F.array_union("va", "vb")), 1, K)
    common = F.array_intersect(F.array_intersect("va", "vb"), F.col("u"))
    size = F.size("u")
    # A union sketch of under K values is the whole union.
    allowed = F.when(size < K, 4 * F.size("c") >= 3 * size).otherwise(F.size("c") >= SHARED)
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("u", union).withColumn("c", common).filter(allowed)
        .select("a", "b", (F.size("c") / size).alias("estimate"))
    )


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose full sets have a Jaccard similarity of at least 0.75.

    Full sets are made again from the texts of the documents that occur in a pair, one for each class.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = full_sets(docs.join(wanted, "doc_id", "left_semi"))
    sets = cut(_of_nodes(sets, classes))
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("va"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("vb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("va").alias("na"), F.size("vb").alias("nb"), F.size(F.array_intersect("va", "vb")).alias("both"))
    return met.filter("100L * both >= 75L * (na + nb - both)").select("a", "b")


def _met(entries: DataFrame, shared: str) -> DataFrame:
    """Pairs of entries (g, node, component, n, ``shared``) of one list from different components that can be similar.

    The members outside a list's largest component meet all members of other components; pairs inside the largest
    component, where a group of copies is, are never made. ``shared`` bounds the intersection; ``p`` are all lists of a
    document, and a pair is made in the first list that it has in common only.
    """
    counts = entries.groupBy("g", "component").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("g").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    told = cut(entries.join(main.select("g", "main"), "g"))
    columns = ("node", "component", "n", shared, "p")
    rest = told.filter("component <> main").select("g", *[F.col(c).alias(f"{c}_x") for c in columns])
    every = told.select("g", (F.col("component") == F.col("main")).alias("main_y"), *[F.col(c).alias(f"{c}_y") for c in columns])
    met = rest.join(every, "g").filter(
        (F.col("component_x") != F.col("component_y")) & (F.col("main_y") | (F.col("node_x") < F.col("node_y")))
        & _near("n_x", "n_y") & (3 * (F.col("n_x") + F.col("n_y")) <= 7 * F.least(f"{shared}_x", f"{shared}_y"))
        & (F.array_min(F.array_intersect("p_x", "p_y")) == F.col("g"))
    )
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def undecided(lists: DataFrame, found: DataFrame, docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of open lists that lie in different components and can still be similar.

    A shingle is live when two components have it. An intersection holds at least 3/4 of the n shingles of either
    document, so with at most x shingles in common a partner has at most (7 x - 3 n) / 3. Two cases cover all pairs.
    Those that share a rare live shingle (at most ``RARE`` documents) meet in its short list and are estimated by
    their sketches. For all others rare shingles are of no use: documents whose frequent live shingles are under 3/4
    of them are out, as is who finds no partner small enough in its lists.
    """
    labelled = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parted = labelled.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    members = cut(labelled.join(parted, "value", "left_semi").select("node", "component").distinct())
    sets = _of_nodes(full_sets(docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")), classes)
    postings = cut(sets.join(members, "node").select("node", "component", F.col("n_shingles").alias("n"), F.explode("values").alias("g")))
    live = postings.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df")).filter("lo < hi").select("g", "df")
    kept = cut(
        postings.join(live, "g").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("x"))
        .withColumn("live", F.size("x").cast("long")).filter("4 * live >= 3 * n")
    )
    first = F.slice("x", F.lit(1), F.greatest(F.col("live") - F.ceil(F.col("n") * 0.75) + 1, F.lit(0)).cast("int"))
    listed = lambda df, p: df.withColumn("p", p).select("node", "component", "n", "live", "p", F.explode("p").alias("g"))
    rare = listed(kept, F.filter(first, lambda x: x["df"] <= RARE)["g"])
    frequent = kept.withColumn("x", F.filter("x", lambda x: x["df"] > RARE)).withColumn("live", F.size("x").cast("long")).filter("4 * live >= 3 * n")
    frequent = listed(frequent, first["g"])
    for _ in range(2):
        smallest = frequent.groupBy("g").agg(F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        frequent = cut(frequent.join(smallest, "g").filter("lo < hi AND 3 * least <= 7 * live - 3 * n").drop("least", "lo", "hi"))
    return estimated(_met(rare, "live"), nodes).select("a", "b").unionByName(_met(frequent, "live")).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """(h1, h2, node): every distinct non-empty set with the smallest doc_id that has it."""
    return rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A null or empty text has an empty set, is linked with nothing and kept. Rows with the same doc_id count as one
    document: their links are joined. A row without doc_id takes part in nothing: component_id is null, kept is
    true. Equal sets are linked whatever their order in the text. Other columns are not read.
    """
    rows = cut(sketches(docs))
    classes = cut(classes_of(rows))
    nodes = cut(_of_nodes(rows, classes))
    lists = cut(prefix_lists(nodes))
    heads = lists.groupBy("value").agg(
        F.max(F.struct("rank", -F.col("node"), F.col("node").alias("node"), "n")).alias("head"), F.count(F.lit(1)).alias("m")
    ).filter("m > 1")
    stars = (
        lists.join(heads.select("value", F.col("head.node").alias("a"), F.col("head.n").alias("na")), "value")
        .filter((F.col("a") != F.col("node")) & _near("n", "na")).select("a", F.col("node").alias("b")).distinct()
    )
    scored = estimated(stars, nodes)
    best = cut(scored.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b"))
    # Rows of one doc_id with different sets are one document.
    split = classes.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("node")
    same = rows.join(split.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").join(classes, ["h1", "h2"])
    repeated = same.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    first = cut(verified(best, docs, classes).unionByName(repeated))
    tested = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_pairs = cut(undecided(lists, cut(components(first)), docs, nodes, classes).join(tested, ["a", "b"], "left_anti"))
    links = first if open_pairs.isEmpty() else first.unionByName(verified(open_pairs, docs, classes))
    found = components(links)
    by_class = classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), None).otherwise(F.col("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "h1", "h2").join(by_class, ["h1", "h2"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
