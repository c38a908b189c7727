"""Filter interaction audit over a sparse document-term matrix.

1. Documents are packed into blocks of bounded text. A block counts its words once, by block-local codes.
2. A block sends its distinct words to buckets of the hash space, one row a bucket. A bucket ranks the words of all
   blocks and answers each block in the order asked. A word's id is its rank after the words of all buckets before:
   a contiguous dictionary of the whole corpus without a task that sees it whole, and without a row a word.
3. With the answers a block turns its codes into a CSR shard: row i of a shard has the columns
   ``indices[indptr[i]:indptr[i + 1]]`` and the counts beside them in ``data``.
4. Row sums are the words of a document, nonzero counts its distinct words: filters A and B. Filters C, D and E are
   attached by document.
5. Documents become one count per part and combination of failed filters, at most 32 a part. All orders are read
   from those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.llm import words as W
from chunkloom.session import cut

FILTERS = "ABCDE"
LEAST_WORDS = 100           # A: fewer words
DISTINCT_SHARE = 80         # B: under this percentage of distinct words
UPPER_SHARE = 10            # C: more than this percentage of A-Z among the code points
SYMBOLS = b"#$%&*|"         # D: any of these

BLOCK_BYTES = 4 << 20       # text of a block; a single longer text is a block of its own
BUCKET_WORDS = 1 << 20      # words of all blocks in one bucket of the dictionary, on average

CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))
BLOCK = (
    "block string, ids array<long>, parts array<string>, keys array<binary>, flags array<int>, "
    "lengths binary, codes binary, counts binary, n_words long, vocabulary binary"
)
ASKED = "bucket int, block string, words binary"
ANSWER = "bucket int, block string, ranks binary, n_words long, words binary"
SHARD = (
    "shard string, ids array<long>, parts array<string>, keys array<binary>, flags array<int>, "
    "indptr binary, indices binary, data binary"
)
ROWS = "doc_id long, part string, key binary, words long, distinct_words long, flags int"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _text_flags(text: bytes) -> int:
    """Bits of the filters that look at characters only."""
    upper = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return (4 if 100 * upper > UPPER_SHARE * points else 0) | (8 if symbols else 0)


def _block(name: str, ids: list, parts: list, texts: list[bytes]) -> pa.RecordBatch:
    codes, lengths, vocabulary = W.coded([W.space_words(t, lower=False) for t in texts])
    # Codes in the order of hashes: the words of a bucket are neighbours.
    order = np.argsort(W.hashes(vocabulary), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner = np.repeat(np.arange(len(texts)), lengths)
    cell, counts = np.unique(owner * max(len(order), 1) + rank[codes], return_counts=True)
    row, column = np.divmod(cell, max(len(order), 1))
    words = zstandard.ZstdCompressor(level=1).compress(b" ".join(vocabulary[i] for i in order))
    return pa.RecordBatch.from_arrays([
        pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([parts], pa.list_(pa.string())),
        pa.array([[hashlib.sha256(t).digest() for t in texts]], pa.list_(pa.binary())), pa.array([[_text_flags(t) for t in texts]], pa.list_(pa.int32())),
        pa.array([W.narrow(np.bincount(row, minlength=len(texts)))], pa.binary()), pa.array([W.narrow(column)], pa.binary()),
        pa.array([W.narrow(counts)], pa.binary()), pa.array([len(order)], pa.int64()), pa.array([words], pa.binary()),
    ], _names(BLOCK))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, size = TaskContext.get().partitionId(), 0, 0
    ids, parts, texts = [], [], []
    for batch in batches:
        for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), W.binary_column(batch, "text")):
            ids.append(doc_id)
            parts.append(lang)
            texts.append(text)
            size += len(text) + 64
            if size >= BLOCK_BYTES:
                yield _block(f"{part}-{number}", ids, parts, texts)
                ids, parts, texts, size, number = [], [], [], 0, number + 1
    if ids:
        yield _block(f"{part}-{number}", ids, parts, texts)


def blocks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """Stored blocks of ``docs`` (doc_id, text and the column ``part``) with block-local word codes."""
    none = F.lit("")
    return cut(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{part}`"].cast("string"), none).alias("lang"),
        F.coalesce(docs["text"], none).cast("binary").alias("text"),
    ).mapInArrow(_pack, BLOCK))


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = zstandard.ZstdDecompressor().decompress(packed).split()
                bucket = (W.hashes(words) >> np.uint64(64 - bits)).astype(np.int64)
                ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([
                    pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.string()),
                    pa.array([b" ".join(words[ends[b]: ends[b + 1]]) for b in some], pa.binary()),
                ], _names(ASKED))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Ranks among the words of one bucket for each block in the order asked; one row of the bucket's words."""
    asked = table.to_pydict()
    lists = [words.split() for words in asked["words"]]
    column = pa.array(chain.from_iterable(lists), pa.binary(), size=sum(map(len, lists))).dictionary_encode()
    order = pa.compute.sort_indices(column.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ranks, ends = rank[column.indices.to_numpy()], np.cumsum([len(x) for x in lists])
    n = len(lists)
    return pa.table({
        "bucket": pa.array(asked["bucket"] + asked["bucket"][:1], pa.int32()), "block": pa.array(asked["block"] + [None], pa.string()),
        "ranks": pa.array([W.narrow(ranks[e - len(x): e]) for e, x in zip(ends, lists)] + [None], pa.binary()),
        "n_words": pa.array([None] * n + [len(order)], pa.int64()),
        "words": pa.array([None] * n + [b" ".join(column.dictionary.take(order).to_pylist())], pa.binary()),
    })


def dictionary(packed: DataFrame) -> DataFrame:
    """Stored answers of all buckets to all blocks, with the words of each bucket in the row without block."""
    size = packed.agg(F.sum("n_words")).first()[0] or 0
    bits = min(max((size // BUCKET_WORDS).bit_length(), 1), 30)
    return cut(packed.select("block", "vocabulary").mapInArrow(_ask(bits), ASKED).groupBy("bucket").applyInArrow(_answer, ANSWER))


def _offsets(answers: DataFrame) -> dict[int, int]:
    """How many words come before those of each bucket: one number for about ``BUCKET_WORDS`` words of blocks."""
    total, before = 0, {}
    for row in answers.filter("block IS NULL").select("bucket", "n_words").orderBy("bucket").toLocalIterator():
        before[row["bucket"]] = total
        total += row["n_words"]
    return before


def words(answers: DataFrame) -> DataFrame:
    """(id, word): the dictionary as rows."""
    before = _offsets(answers)

    def run(batches):
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = packed.split()
                yield pa.RecordBatch.from_arrays([pa.array(before[bucket] + np.arange(len(found))), pa.array(found, pa.binary())], ["id", "word"])

    return answers.filter("block IS NULL").select("bucket", "words").mapInArrow(run, "id long, word binary")


def _shards(before: dict[int, int]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        mine = answers.sort_by("bucket").to_pydict()
        ids = [before[b] + W.widen(r) for b, r in zip(mine["bucket"], mine["ranks"])]
        lengths = W.widen(row["lengths"])
        columns = np.concatenate([np.zeros(0, np.int64), *ids])[W.widen(row["codes"])]
        sort = np.lexsort((columns, np.repeat(np.arange(len(lengths)), lengths)))
        return pa.table({
            "shard": pa.array([row["block"]]), "ids": pa.array([row["ids"]], pa.list_(pa.int64())), "parts": pa.array([row["parts"]], pa.list_(pa.string())),
            "keys": pa.array([row["keys"]], pa.list_(pa.binary())), "flags": pa.array([row["flags"]], pa.list_(pa.int32())),
            "indptr": pa.array([W.narrow(np.concatenate([[0], np.cumsum(lengths)]))], pa.binary()),
            "indices": pa.array([W.narrow(columns[sort])], pa.binary()), "data": pa.array([W.narrow(W.widen(row["counts"])[sort])], pa.binary()),
        })

    return run


def matrix(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """CSR shards of the document-term matrix, one for each of the blocks ``packed``, in the ids of the dictionary."""
    asked = answers.filter("block IS NOT NULL").select("block", "bucket", "ranks")
    whole = packed.drop("n_words", "vocabulary").groupBy("block").cogroup(asked.groupBy("block"))
    return whole.applyInArrow(_shards(_offsets(answers)), SHARD)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            indptr, data = W.widen(row["indptr"]), W.widen(row["data"])
            sums = np.diff(np.concatenate([[0], np.cumsum(data)])[indptr])
            nonzero = np.diff(indptr)
            flags = np.array(row["flags"], np.int64)
            flags += np.where(sums < LEAST_WORDS, 1, 0) + np.where(100 * nonzero < DISTINCT_SHARE * sums, 2, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(row["parts"], pa.string()), pa.array(row["keys"], pa.binary()),
                pa.array(sums), pa.array(nonzero), pa.array(flags.astype(np.int32)),
            ], _names(ROWS))


def flagged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, words, distinct_words, failed): one row a document; bit i of ``failed`` is filter ``FILTERS[i]``.

    A document fails E if a document with a smaller id has the same text. A row without doc_id is the first of nobody
    and a repetition of nobody; repeated rows of one doc_id are no repetitions of each other.
    """
    packed = blocks(docs, part)
    rows = cut(matrix(packed, dictionary(packed)).mapInArrow(_measured, ROWS))
    # Firsts are joined by document, so a text that a third of all documents have is no hot key.
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    return rows.join(firsts, ["doc_id", "key"], "left").select("doc_id", "part", "words", "distinct_words", (F.col("flags") + again).alias("failed"))


def combinations(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part by the filters they fail."""
    told = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    return rows.join(told, "doc_id", "left").groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Counts of every step of every order of the filters, for each value of the column ``part`` (null as empty).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); the filter of a
    step is that letter of ``filter_order``. A null text is empty: it fails A, and E where an empty text has a smaller
    id. Labels of one document are joined by their maximum; labels without doc_id or of no document are ignored. Every
    row of ``docs`` counts, repeated ones too. Without documents there are no parts, so no rows.
    """
    counts = cut(combinations(flagged(docs, part), labels))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    place = {name: F.instr("filter_order", name) for name in FILTERS}
    bits = lambda holds: sum((F.when(holds(place[name]), 1 << i).otherwise(0) for i, name in enumerate(FILTERS)), F.lit(0))
    steps = (
        counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("before", bits(lambda at: at < F.col("step"))).withColumn("own", bits(lambda at: at == F.col("step")))
        .withColumn("fails", F.col("failed").bitwiseAND(F.col("own")) > 0).withColumn("gone", F.col("failed").bitwiseAND(F.col("before")) > 0)
    )
    total = lambda holds, what="n": F.sum(F.when(holds, F.col(what)).otherwise(F.lit(0))).cast("long")
    fails, gone = F.col("fails"), F.col("gone")
    summed = steps.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
