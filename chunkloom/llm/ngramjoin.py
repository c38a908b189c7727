"""Jaccard join of documents on their distinct word n-grams by rare-first prefix filtering.

The order. Texts are packed into blocks. A block sends its distinct n-grams, as sorted gap-coded hashes, to buckets of
the hash space; a bucket counts in how many blocks' documents each occurs and answers each block in the order asked.
All n-grams are then ordered by (frequency class, hash), a rare one first. Hashes are cut to 32 bits and the bits of
the bucket on that way: two n-grams that fall together look more frequent than they are, which only moves them in an
order that is the same for all documents.

Prefixes. With ``share`` percent wanted, sets of n and m n-grams share at least ``share * (n + m) / (100 + share)``, so
linked documents meet in an n-gram that is among the first ``n - ceil(share * n / 100) + 1`` of both. N-grams of one
document can't be met; they take places in a prefix but make no entry. Documents whose prefix has none but those are
linked with nothing and go no further.

Filters of a pair that meets first at positions p and q (from 0):

- length: ``100 * min(n, m) >= share * max(n, m)``; bands of lengths are part of the join key;
- position: at most ``min(n - p, m - q)`` n-grams are shared;
- suffix: the n-grams after the prefixes are counted by ``BINS`` ranges of their hashes; what the prefixes leave and
  the smaller count of each range bound the shared n-grams.

Equal sets are one class, which its smallest doc_id stands for. Pairs are made in two steps, so that a large group of
near copies is never paired with itself. First every document meets the member of a list whose entry comes first there,
the centre of a group of near copies; it is verified with the one centre that it meets most often. The links found
make components, and in the second step only pairs between different components meet, in all lists that still
hold several. Both steps are exact; a pair is made at its first common n-gram and verified once, on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.llm import words as W
from chunkloom.llm.components import components
from chunkloom.operators.skew import spread_join
from chunkloom.session import cut

SIZE = 3
SHARE = 90
BLOCK_TOKENS = 3 << 18
PACK_ROWS = 256             # texts of a batch that are words at a time
BUCKET_GRAMS = 1 << 20      # n-grams of all blocks in a bucket, on average
BINS = 32
LIST_PART = 2048            # members of a list that meet in one cell, and rows of a key that are joined as one

BLOCK = "block string, ids array<long>, n_grams long, lengths binary, vocabulary binary, codes binary"
ASKED = "bucket int, block string, gaps binary"
ANSWER = "bucket int, block string, classes binary"
NODES = "doc_id long, n_shingles long, h1 long, h2 long, first int, taken int, prefix array<long>, bins array<int>, grams array<long>"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _block(name: str, ids: list, lengths: list[int], words: list[pa.Array]) -> pa.RecordBatch:
    coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
    return pa.RecordBatch.from_arrays([
        pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([sum(lengths)], pa.int64()),
        pa.array([W.narrow(np.array(lengths, np.int64))], pa.binary()), pa.array([W.hashes(coded.dictionary.to_pylist()).tobytes()], pa.binary()),
        pa.array([W.narrow(coded.indices.to_numpy())], pa.binary()),
    ], _names(BLOCK))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, total = TaskContext.get().partitionId(), 0, 0
    ids, lengths, words = [], [], []
    for batch in batches:
        for start in range(0, batch.num_rows, PACK_ROWS):
            piece = batch.slice(start, PACK_ROWS)
            for doc_id, text in zip(piece.column(0).to_pylist(), W.binary_column(piece, "text")):
                found = W.space_words(text)
                ids.append(doc_id)
                lengths.append(len(found))
                # Words wait as columns, which take a tenth of the memory of Python's objects.
                words.append(pa.array(found, pa.binary()))
                total += len(found) + 1
                if total >= BLOCK_TOKENS:
                    yield _block(f"{part}-{number}", ids, lengths, words)
                    ids, lengths, words, total, number = [], [], [], 0, number + 1
    if ids:
        yield _block(f"{part}-{number}", ids, lengths, words)


def gram_sets(lengths: np.ndarray, hashed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a block in order, and the documents and numbers of the n-grams that each document has."""
    stops = np.cumsum(lengths)
    rolled = W.rolled(hashed, size) if len(hashed) >= size else np.zeros(0, np.uint64)
    whole = np.flatnonzero(lengths >= size)
    counts = lengths[whole] - size + 1
    starts = stops[whole] - lengths[whole]
    owner = np.repeat(whole, counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    single = [W.rolled(hashed[stops[i] - lengths[i]: stops[i]], size)[0] for i in short]
    value, number = np.unique(np.concatenate([rolled[at], np.array(single, np.uint64)]), return_inverse=True)
    cell = np.unique(np.concatenate([owner, short]) * max(len(value), 1) + number)
    document, number = np.divmod(cell, max(len(value), 1))
    return value, document, number


def _sets_of(row: dict, size: int):
    lengths = W.widen(row["lengths"])
    return lengths, *gram_sets(lengths, np.frombuffer(row["vocabulary"], np.uint64)[W.widen(row["codes"])], size)


def _packed(low: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted hashes as gaps, and their counts: the length of the first part in four bytes, then both."""
    gaps = W.narrow(np.diff(low, prepend=np.uint64(0)))
    return len(gaps).to_bytes(4, "little") + gaps + W.narrow(times)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut_at = 4 + int.from_bytes(packed[:4], "little")
    return np.cumsum(W.widen(packed[4:cut_at])), W.widen(packed[cut_at:])


def _ask(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                _, value, document, number = _sets_of(row, size)
                # A document more for every further document of the block that has the n-gram.
                times = np.bincount(number, minlength=len(value))
                bucket = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
                low = (value >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
                ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(ends))
                gaps = []
                for b in some:
                    part = slice(ends[b], ends[b + 1])
                    gaps.append(_packed(low[part], times[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([row["block"]] * len(some), pa.string()), pa.array(gaps, pa.binary())], _names(ASKED)
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Frequency class of each n-gram asked for: 0 for those of one document, else by eighths of powers of two."""
    asked = table.to_pydict()
    parts = [_unpacked(g) for g in asked["gaps"]]
    _, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    documents = np.bincount(number, weights=np.concatenate([p[1] for p in parts]))
    kind = np.where(documents < 2, 0, np.minimum(np.floor(8 * np.log2(documents)) - 7, 255)).astype(np.uint8)[number]
    ends = np.cumsum([len(p[0]) for p in parts])
    out = pa.table({
        "bucket": pa.array(asked["bucket"], pa.int32()), "block": pa.array(asked["block"], pa.string()),
        "classes": pa.array([kind[e - len(p[0]): e].tobytes() for e, p in zip(ends, parts)], pa.binary()),
    })
    del parts, number, documents, kind
    W.give_back()
    return out


def _nodes(size: int, share: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in _names(NODES)}
        for row in blocks.to_pylist():
            lengths, value, document, number = _sets_of(row, size)
            kind = np.frombuffer(b"".join(answers.sort_by("bucket").column("classes").to_pylist()), np.uint8)
            ends = np.searchsorted(document, np.arange(len(lengths)), "right")
            for i, (doc_id, end) in enumerate(zip(row["ids"], ends)):
                mine = number[ends[i - 1] if i else 0: end]
                n, grams = len(mine), value[mine]
                first = int((kind[mine] == 0).sum())
                taken = n - -(-share * n // 100) + 1 if n else 0
                met = first < taken
                order = np.argsort(kind[mine], kind="stable")       # grams are in the order of their hashes
                key = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
                later = grams[order[taken:]] >> np.uint64(64 - BINS.bit_length() + 1)
                for name, cell in zip(out, (
                    doc_id, n, int(key[0]), int(key[1]), first, taken, grams[order[first:taken]].view(np.int64) if met else None,
                    np.bincount(later.astype(np.int64), minlength=BINS) if met else None, grams.view(np.int64) if met else None,
                )):
                    out[name].append(cell)
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        made = pa.table({name: pa.array(out.pop(name), kind) for name, kind in zip(_names(NODES), kinds)})
        W.give_back()
        return made

    return run


def profiles(docs: DataFrame, size: int = SIZE, share: int = SHARE) -> DataFrame:
    """A stored row for every row of ``docs``: set size, 128-bit key of the set, and what the join needs.

    ``prefix`` holds the n-grams of the prefix that other documents have too, from position ``first`` on; it, the counts
    ``bins`` after the prefix and the whole set ``grams`` are null where no such n-gram is left.
    """
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    blocks = cut(source.mapInArrow(W.tidy(_pack), BLOCK))
    total = blocks.agg(F.sum("n_grams")).first()[0] or 0
    bits = min((total // BUCKET_GRAMS).bit_length(), 30)
    asked = blocks.select("block", "lengths", "vocabulary", "codes").mapInArrow(W.tidy(_ask(size, bits)), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answer, ANSWER)
    return cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_nodes(size, share), NODES))


def _allowed(shared: Column, n: Column | str, m: Column | str, share: int) -> Column:
    """Whether sets of ``n`` and ``m`` n-grams that share at most ``shared`` can be linked."""
    total = (F.col(n) if isinstance(n, str) else n) + (F.col(m) if isinstance(m, str) else m)
    return (100 + share) * shared >= share * total


def suffix_filter(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """``pairs`` (a, b, pa, pb) that the n-grams after the prefixes still allow.

    In the common order the prefix of one of the two ends first, so of the n-grams of prefixes only what one of them
    has left from the meeting on can be shared.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("taken").alias(f"t{x}"), F.col("bins").alias(f"s{x}"))
    met = spread_join(spread_join(pairs, side("a"), ["a"], "b", rows_per_part=LIST_PART), side("b"), ["b"], "a", rows_per_part=LIST_PART)
    suffix = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = F.greatest(F.col("ta") - F.col("pa"), F.col("tb") - F.col("pb"))
    return met.filter(_allowed(left + suffix, "na", "nb", share)).select("a", "b").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """``pairs`` (a, b) whose whole sets are similar enough."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}"))
    met = spread_join(spread_join(pairs, side("a"), ["a"], "b", rows_per_part=LIST_PART), side("b"), ["b"], "a", rows_per_part=LIST_PART)
    both = met.select("a", "b", (F.size("ga") + F.size("gb")).alias("total"), F.size(F.array_intersect("ga", "gb")).alias("both"))
    return both.filter((100 + share) * F.col("both").cast("long") >= share * F.col("total").cast("long")).select("a", "b").distinct()


def central_pairs(entries: DataFrame, share: int) -> DataFrame:
    """(a, b, pa, pb): every node ``b`` with the centre ``a`` that it meets in most of its lists."""
    centre = F.min(F.struct("pos", F.col("node"), F.col("n")))
    heads = entries.groupBy("g").agg(centre.alias("head"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(
        "g", F.col("head.node").alias("a"), F.col("head.pos").alias("pa"), F.col("head.n").alias("na")
    )
    met = spread_join(entries, heads, ["g"], "node", rows_per_part=LIST_PART).filter(
        (F.col("a") != F.col("node")) & _allowed(F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("pos")), "na", "n", share)
    )
    pairs = met.groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.min("pa").alias("pa"), F.min("pos").alias("pb"))
    best = F.max_by(F.struct("a", "pa", "pb"), F.struct("times", -F.col("a")))
    return pairs.groupBy("b").agg(best.alias("x")).select("x.a", "b", "x.pa", "x.pb")


def open_pairs(entries: DataFrame, found: DataFrame, share: int) -> DataFrame:
    """(a, b, pa, pb): pairs of one list that lie in different components and pass the length and position filters.

    Members outside a list's largest component meet all members of other components. A list is cut into bands of
    lengths, and a long one into cells of bounded size besides.
    """
    labelled = cut(entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    counts = labelled.groupBy("g", "component").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    lists = counts.groupBy("g").agg(
        F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least")
    ).filter("parts > 1").select("g", "main", "m", "least")
    told = cut(
        spread_join(labelled, lists, ["g"], "node", rows_per_part=LIST_PART)
        .filter(_allowed(F.col("n") - F.col("pos"), "n", "least", share))
        .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100.1 / share)).cast("int"))
        .withColumn("cells", F.ceil(F.col("m") / LIST_PART).cast("int"))
    )
    columns = ("node", "component", "n", "pos")
    rest = told.filter("component <> main").select(
        "g", "band", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), *[F.col(c).alias(f"{c}_x") for c in columns]
    )
    every = told.select(
        "g", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "cells",
        (F.col("component") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"{c}_y") for c in columns]
    ).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    met = rest.join(every, ["g", "band", "cell"]).filter(
        (F.col("component_x") != F.col("component_y")) & (F.col("in_main") | (F.col("node_x") < F.col("node_y")))
        & _allowed(F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")), "n_x", "n_y", share)
    )
    swap = F.col("node_x") > F.col("node_y")
    pick = lambda low, high, name: F.when(swap, F.col(high)).otherwise(F.col(low)).alias(name)
    ends = met.select(pick("node_x", "node_y", "a"), pick("node_y", "node_x", "b"), pick("pos_x", "pos_y", "pa"), pick("pos_y", "pos_x", "pb"))
    return ends.groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))


def linked(docs: DataFrame, size: int = SIZE, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); other columns are not read.

    Words are set apart by blanks and A-Z are lower-cased. A text with fewer than ``size`` words is one n-gram, a null
    or empty one has none and is linked with nothing. Rows of one doc_id are one document: their links are joined.
    A row without doc_id takes part in nothing, its component_id is null. Equal sets are linked in any order.
    """
    rows = profiles(docs, size, share)
    whole = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    members = classes.withColumnRenamed("node", "doc_id")
    # A class that stands for itself is one row, whatever the number of its copies.
    nodes = cut(
        whole.filter("prefix IS NOT NULL").join(members, ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["h1", "h2"])
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "first", "taken", "prefix", "bins", "grams")
    )
    entries = nodes.select("node", "n", "first", F.posexplode("prefix").alias("i", "g")).select("g", "node", "n", (F.col("first") + F.col("i")).alias("pos"))
    # An n-gram that only copies of one text have makes a list of one.
    met = entries.groupBy("g").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("g")
    entries = cut(spread_join(entries, met, ["g"], "node", rows_per_part=LIST_PART))
    central = cut(central_pairs(entries, share))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Rows of one doc_id with different sets are one document.
    split = whole.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).filter("lo < hi").select("doc_id")
    same = whole.select("doc_id", "h1", "h2").join(split, "doc_id", "left_semi").distinct().join(classes, ["h1", "h2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    first = cut(verified(suffix_filter(central, nodes, share), nodes, share).unionByName(same))
    later = open_pairs(entries, cut(components(first)), share).join(ordered(central), ["a", "b"], "left_anti")
    links = cut(first.unionByName(verified(cut(suffix_filter(later, nodes, share)), nodes, share)))
    named = classes.join(components(links), "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return (
        rows.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
    )
