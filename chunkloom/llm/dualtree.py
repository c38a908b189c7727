"""Ranked lexical search of all items at once by a dual-tree traversal.

A document scores ``sum of w * ((10**9 * tf) div (1000 * tf + 20 * m))`` over an item's terms: ``w`` is the term's
weight, the quotient the document's coordinate of the term. Weights are not negative, so raising a coordinate never
lowers a score.

1. One pass over the documents keeps their lengths and the occurrences of terms that the items have, and the table is
   sorted by each document's term of greatest weight, so documents that lie side by side are alike.
2. Statistics (documents, terms, document frequencies) come from that table and give the weights.
3. A task cuts its rows into shards of bounded size and builds a tree over each: leaves of ``LEAF`` neighbouring
   documents, ``FAN`` nodes to a parent, every node with the maxima of its coordinates. The items form a tree of
   their own, alike ones side by side, every node with the maxima of its members' weights.
4. Pairs of nodes are taken apart from the roots down. The product of two nodes' maxima bounds every score between
   their members; a pair whose bound is below the weakest of its items' k-th scores is dropped with all its members.
   Scores are products and sums of whole numbers under 2**53, so bounds and scores in doubles are exact.
5. Thresholds: a first traversal goes to the best leaf of each item in every shard only. The k-th best of all scores
   found so is at most an item's true k-th score, so the second, whole traversal starts with it and loses nothing.

Items are taken in batches of bounded text (``BATCH_BYTES``), which is what a task holds of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.llm import words as W
from chunkloom.session import cut

TOP = 50
BATCH_BYTES = 4 << 20       # text of the items of one pass
ITEM_LEAF, LEAF, FAN = 8, 16, 4
SHARD_CELLS = 1 << 22       # documents x terms of a shard; a single document can have more
SHARD_DOCS = 4096
PROBED = 8                  # scores of an item that a shard tells to the thresholds
SALTS = 64

VECTORS = "doc_id long, n long, codes binary, counts binary"
FOUND = "item int, doc_id long, score long"


def _item_terms(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct terms of ``texts`` and the sorted term codes of each."""
    codes, lengths, vocabulary = W.coded([W.alnum_words(t) for t in texts])
    stops = np.cumsum(lengths)
    return vocabulary, [np.unique(codes[e - n: e]).astype(np.int64) for e, n in zip(stops, lengths)]


def _vectors(vocabulary: list[bytes]):
    """Lengths and item terms of each document; a document without any term is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.binary())
        for batch in batches:
            ids, texts = batch.column(0), W.binary_column(batch, "text")
            for a, b in W.groups(texts):
                codes, lengths, local = W.coded([W.alnum_words(t) for t in texts[a:b]])
                place = pa.compute.index_in(pa.array(local, pa.binary()), value_set=wanted).fill_null(-1).to_numpy().astype(np.int64)
                term = place[codes] if len(codes) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(b - a), lengths)[term >= 0]
                cell, tf = np.unique(owner * max(len(vocabulary), 1) + term[term >= 0], return_counts=True)
                row, column = np.divmod(cell, max(len(vocabulary), 1))
                stops = np.searchsorted(row, np.arange(b - a), "right")
                starts = np.concatenate([[0], stops[:-1]])
                some = np.flatnonzero(lengths)
                yield pa.RecordBatch.from_arrays([
                    ids[a:b].take(pa.array(some)), pa.array(lengths[some]),
                    pa.array([W.narrow(column[starts[i]: stops[i]]) for i in some], pa.binary()),
                    pa.array([W.narrow(tf[starts[i]: stops[i]]) for i in some], pa.binary()),
                ], ["doc_id", "n", "codes", "counts"])

    return run


def _frequencies(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total[W.widen(packed)] += 1
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "df"])

    return run


def _heads(weights: np.ndarray):
    """Each row with ``head``, its term of greatest weight: the key by which documents become neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = []
            for packed in batch.column(2).to_pylist():
                codes = W.widen(packed)
                head.append(int(codes[np.argmax(weights[codes])]) if len(codes) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.int64())], [*batch.schema.names, "head"])

    return run


class ItemTree:
    """Items in levels of nodes, leaves first; every node has its terms and the maxima of its items' weights."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        heads = [int(t[np.argmax(weights[t])]) if len(t) else -1 for t in terms]
        self.order = np.array(sorted(range(len(terms)), key=lambda i: (heads[i], i)), np.int64)
        self.members = [self.order[i: i + ITEM_LEAF] for i in range(0, len(terms), ITEM_LEAF)]
        self.children = [None] * len(self.members)
        self.terms = [np.unique(np.concatenate([terms[i] for i in m])) for m in self.members]
        level = list(range(len(self.members)))
        while len(level) > 1:
            above = []
            for i in range(0, len(level), FAN):
                part = level[i: i + FAN]
                above.append(len(self.terms))
                self.children.append(part)
                self.members.append(np.concatenate([self.members[c] for c in part]))
                self.terms.append(np.unique(np.concatenate([self.terms[c] for c in part])))
            level = above
        self.root = level[0]
        self.weights = weights
        self.matrix = []
        for m, t in zip(self.members, self.terms):
            leaf = np.zeros((len(t), len(m)))
            if self.children[len(self.matrix)] is None:
                for j, i in enumerate(m):
                    leaf[np.searchsorted(t, terms[i]), j] = weights[terms[i]]
            self.matrix.append(leaf)


class Shard:
    """Documents of a shard in levels of nodes with the maxima of their coordinates, as rows over the shard's terms."""

    def __init__(self, ids: np.ndarray, coordinates: np.ndarray, terms: np.ndarray):
        self.ids, self.terms = ids, terms
        self.levels = [coordinates]
        size = LEAF
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), size), axis=0))
            size = FAN

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        step = LEAF if level == 1 else FAN
        below = (nodes[:, None] * step + np.arange(step)).ravel()
        return below[below < len(self.levels[level - 1])]


class Search:
    """Dual-tree traversal of one shard with the k best documents of every item so far."""

    def __init__(self, tree: ItemTree, shard: Shard, least: np.ndarray, top: int):
        self.tree, self.shard, self.top = tree, shard, top
        self.least = least.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(least)
        place = np.searchsorted(shard.terms, np.concatenate([np.zeros(0, np.int64), *tree.terms]))
        self.columns, at = [], 0
        for t in tree.terms:
            p = np.minimum(place[at: at + len(t)], max(len(shard.terms) - 1, 0))
            there = shard.terms[p] == t if len(shard.terms) else np.zeros(len(t), bool)
            self.columns.append((p[there], there))
            at += len(t)

    def bounds(self, node: int, level: int, rows: np.ndarray) -> np.ndarray:
        columns, there = self.columns[node]
        return self.shard.levels[level][np.ix_(rows, columns)] @ self.tree.weights[self.tree.terms[node][there]]

    def scored(self, node: int, rows: np.ndarray) -> None:
        """Exact scores of an item leaf's members and the documents ``rows``; keeps each item's best."""
        columns, there = self.columns[node]
        scores = self.shard.levels[0][np.ix_(rows, columns)] @ self.tree.matrix[node][there]
        for j, item in enumerate(self.tree.members[node]):
            good = np.flatnonzero(scores[:, j] >= max(self.least[item], 1))
            if not len(good):
                continue
            value = np.concatenate([self.best[item][0], scores[good, j]])
            ids = np.concatenate([self.best[item][1], self.shard.ids[rows[good]]])
            first = np.lexsort((ids, -value))[: self.top]
            self.best[item] = value[first], ids[first]
            if len(first) == self.top:
                self.least[item] = max(self.least[item], value[first[-1]])

    def whole(self) -> None:
        """All pairs of nodes from the roots down; the documents of one item leaf are scored best leaf first."""
        top = len(self.shard.levels) - 1
        stack = [(self.tree.root, top, np.zeros(1, np.int64))]
        while stack:
            node, level, rows = stack.pop()
            bound = self.bounds(node, level, rows)
            keep = bound >= max(self.least[self.tree.members[node]].min(), 1)
            rows, bound = rows[keep], bound[keep]
            if not len(rows):
                continue
            down = self.tree.children[node]
            if down is not None:
                below = self.shard.children(level, rows) if level > 1 else rows
                stack += [(c, max(level - 1, min(level, 1)), below) for c in down]
            elif level > 1:
                stack.append((node, level - 1, self.shard.children(level, rows)))
            else:
                self._leaves(node, level, rows, bound)

    def _leaves(self, node: int, level: int, rows: np.ndarray, bound: np.ndarray) -> None:
        order = np.argsort(-bound, kind="stable")
        members = self.tree.members[node]
        at, step = 0, 2
        while at < len(order):
            part = order[at: at + step]
            part = part[bound[part] >= max(self.least[members].min(), 1)]
            if not len(part):
                return
            self.scored(node, self.shard.children(level, rows[part]) if level else rows[part])
            at, step = at + step, min(2 * step, 64)

    def probe(self) -> None:
        """Scores of the most promising leaf of each item leaf."""
        level = min(1, len(self.shard.levels) - 1)
        rows = np.arange(len(self.shard.levels[level]))
        for node, down in enumerate(self.tree.children):
            if down is None and len(self.columns[node][0]):
                best = np.array([int(np.argmax(self.bounds(node, level, rows)))])
                self.scored(node, self.shard.children(level, best) if level else best)


def _shard_of(rows: list[tuple], places: list[np.ndarray], documents: int, length: int) -> Shard:
    terms = np.unique(np.concatenate(places))
    out = np.zeros((len(rows), len(terms)))
    for i, ((_, n, _, counts), codes) in enumerate(zip(rows, places)):
        tf = W.widen(counts)
        m = 50 + (50 * n * documents) // length
        out[i, np.searchsorted(terms, codes)] = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    return Shard(np.array([r[0] for r in rows], np.int64), out, terms)


def _shards(batches: Iterator[pa.RecordBatch], documents: int, length: int) -> Iterator[Shard]:
    rows, places, terms, width = [], [], set(), 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            codes = W.widen(row[2])
            if row[0] is None or not len(codes):
                continue
            rows.append(row)
            places.append(codes)
            terms.update(codes.tolist())
            width = len(terms)
            if len(rows) * width >= SHARD_CELLS or len(rows) >= SHARD_DOCS:
                yield _shard_of(rows, places, documents, length)
                rows, places, terms = [], [], set()
    if rows:
        yield _shard_of(rows, places, documents, length)


def _search(terms: list[np.ndarray], weights: np.ndarray, least: np.ndarray, documents: int, length: int, top: int, probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ItemTree(terms, weights)
        for shard in _shards(batches, documents, length):
            search = Search(tree, shard, least, PROBED if probe else top)
            search.probe() if probe else search.whole()
            for item, (score, ids) in enumerate(search.best):
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), item, np.int32)), pa.array(ids), pa.array(score.astype(np.int64))], ["item", "doc_id", "score"]
                    )

    return run


def _best(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` best rows (score, doc_id) of each group, as an array in order; groups are cut down in parts first."""
    row = F.struct((-F.col("score")).alias("score"), "doc_id")
    parts = found.groupBy(*keys, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, top).alias("best"))
    return parts.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top).alias("best"))


def _batch(spark: SparkSession, docs: DataFrame, items: list[tuple[str, bytes]], top: int) -> DataFrame:
    """(item, rank, doc_id, score) of one batch of items, ``item`` by its place."""
    vocabulary, terms = _item_terms([t for _, t in items])
    vectors = cut(docs.mapInArrow(_vectors(vocabulary), VECTORS))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    documents, length = size["n"], max(size["l"], 1)
    counted = vectors.select("codes").mapInArrow(_frequencies(len(vocabulary)), "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
    # One row a term of the batch, so bounded by its text.
    weigh = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary))
    for code, weight in counted.select("code", weigh.alias("w")).collect():
        weights[code] = weight
    near = vectors.mapInArrow(_heads(weights), VECTORS + ", head long").filter("head IS NOT NULL")
    parts = max(spark.sparkContext.defaultParallelism, documents // (4 * SHARD_DOCS))
    near = cut(near.repartitionByRange(parts, "head", "doc_id").sortWithinPartitions("head", "doc_id").drop("head"))
    least = np.zeros(len(items))
    probed = near.mapInArrow(_search(terms, weights, least, documents, length, top, True), FOUND)
    for row in _best(probed, ["item"], top).filter(F.size("best") == top).select("item", (-F.element_at("best", -1)["score"]).alias("least")).collect():
        least[row["item"]] = row["least"]
    found = near.mapInArrow(_search(terms, weights, least, documents, length, top, False), FOUND)
    return _best(found, ["item"], top).select("item", F.posexplode("best").alias("rank", "x")).select(
        "item", (F.col("rank") + 1).alias("rank"), F.col("x.doc_id").alias("doc_id"), (-F.col("x.score")).alias("score")
    )


def _batches(items: Iterator, limit: int) -> Iterator[list[tuple]]:
    batch, size = [], 0
    for item_id, text in items:
        batch.append((item_id, bytes(text)))
        size += len(text)
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def search(docs: DataFrame, items: DataFrame, top: int = TOP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are not read. Rows of one item_id are one
    item with the terms of all its texts. Items without id or terms, and documents without terms, have no result;
    documents without doc_id count in the statistics only. Repeated documents are ranked each. Scores are above 0.
    """
    spark = docs.sparkSession
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    texts = items.filter(items["item_id"].isNotNull() & items["text"].isNotNull()).groupBy(items["item_id"].alias("item_id")).agg(
        F.array_join(F.sort_array(F.collect_set("text")), " ").cast("binary").alias("text")
    )
    out = None
    for batch in _batches(((r["item_id"], r["text"]) for r in cut(texts).orderBy("item_id").toLocalIterator()), batch_bytes):
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(batch)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _batch(spark, source, batch, top).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(cut(found))
    empty = items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return empty if out is None else out
