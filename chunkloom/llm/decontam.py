"""Benchmark decontamination over a stored, distributed positional inverted index.

The corpus is indexed in segments of about ``SEGMENT_WORDS`` words. One row of the index holds one word of one
segment with its positions (gap-coded bytes); one more row a segment, under the empty word, lists its documents and
their lengths. Building needs no shuffle: a segment is made by the task that reads its documents.

A search takes the test items in blocks of bounded size. Only the index rows of a block's words are read and dealt
by segment. Inside a segment each window of an item starts from its rarest word there and intersects the
offset-adjusted position lists of the others, rarest first; a window with a missing word costs nothing. So the work
of a search follows postings of test words, split over segments; no word or passage, however frequent, meets in one
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.llm import words as W
from chunkloom.session import cut

SEGMENT_WORDS = 1 << 19
WINDOW = 10
BLOCK_BYTES = 4 << 20     # text of test items that one search pass carries to the tasks
INDEX = "segment string, word binary, n int, postings binary, doc_ids array<long>, lengths array<int>"
DOCUMENTS = b""           # the word under which a segment lists its documents


def pack(gaps: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Gaps as 7-bit groups; row i of the result ends before gap ``stops[i]``."""
    size = np.ones(len(gaps), np.int64)
    for bits in (7, 14, 21, 28):
        size += gaps >= (1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        at = np.flatnonzero(size > k)
        out[ends[at] - size[at] + k] = ((gaps[at] >> (7 * k)) & 127) | np.where(size[at] > k + 1, 128, 0)
    return W.blobs(out, ends[np.asarray(stops) - 1] if len(ends) else stops)


def unpack(data: bytes) -> np.ndarray:
    """Positions of one word."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts))


def _segment(name: str, ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
    codes, lengths, vocabulary = W.coded(documents)
    # One free position after each document keeps phrases from running into the next one.
    bases = np.cumsum(lengths + 1) - lengths - 1
    position = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(codes, kind="stable")
    ordered, counts = position[order], np.bincount(codes, minlength=len(vocabulary))
    stops = np.cumsum(counts)
    gaps = np.diff(ordered, prepend=0)
    first = stops - counts
    gaps[first] = ordered[first]
    n = len(vocabulary)
    return pa.RecordBatch.from_arrays([
        pa.array([name] * (n + 1)),
        pa.array(vocabulary + [DOCUMENTS], pa.binary()),
        pa.array(np.append(counts, len(bases)).astype(np.int32)),
        pa.concat_arrays([pack(gaps, stops), pa.array([None], pa.binary())]) if n else pa.array([None], pa.binary()),
        pa.array([None] * n + [ids], pa.list_(pa.int64())),
        pa.array([None] * n + [lengths.tolist()], pa.list_(pa.int32())),
    ], ["segment", "word", "n", "postings", "doc_ids", "lengths"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    documents: list[list[bytes]] = []
    total = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), W.binary_column(batch, "text")):
            found = W.alnum_words(text)
            ids.append(doc_id)
            documents.append(found)
            total += len(found) + 1
            if total >= SEGMENT_WORDS:
                yield _segment(f"{part}-{number}", ids, documents)
                ids, documents, total, number = [], [], 0, number + 1
    if ids:
        yield _segment(f"{part}-{number}", ids, documents)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), stored in the shared folder.

    A null or empty text is a document without words. Rows with equal ids are documents of their own.
    """
    return cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text")).mapInArrow(W.tidy(_index), INDEX))


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, ordinal, doc_id, n_words) of every indexed row."""
    listed = index.filter(F.col("word") == F.lit(DOCUMENTS)).select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("ordinal", "d"))
    return listed.select("segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").cast("long").alias("n_words"))


class Segment:
    """Position lists of one segment, decoded when first asked for."""

    def __init__(self, table: pa.Table):
        words = table.column("word").to_pylist()
        where = words.index(DOCUMENTS)
        lengths = np.array(table.column("lengths")[where].as_py(), np.int64)
        self.stops = np.cumsum(lengths + 1)
        self.bases = self.stops - lengths - 1
        self.size = dict(zip(words, table.column("n").to_pylist()))
        self._packed = dict(zip(words, table.column("postings").to_pylist()))
        self._lists: dict[bytes, np.ndarray] = {}

    def positions(self, word: bytes) -> np.ndarray:
        if word not in self._lists:
            self._lists[word] = unpack(self._packed[word])
        return self._lists[word]

    def phrase(self, phrase: list[bytes]) -> np.ndarray:
        """Positions at which ``phrase`` starts; every word is known to occur in the segment."""
        order = sorted(range(len(phrase)), key=lambda i: self.size[phrase[i]])
        starts = self.positions(phrase[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            starts = starts[_in(self.positions(phrase[i]), starts + i)]
        return starts

    def near(self, terms: list[bytes], span: int) -> np.ndarray:
        """Smallest stretches of at most ``span`` words of one document that hold all ``terms``, as (start, stop) rows."""
        terms = sorted(set(terms), key=self.size.__getitem__)
        anchors = self.positions(terms[0])
        for term in terms[1:]:
            at = self.positions(term)
            anchors = anchors[np.searchsorted(at, anchors - span + 1) < np.searchsorted(at, anchors + span)]
        found = set()
        for anchor in anchors:
            window = sorted(
                (p, k) for k, term in enumerate(terms) for at in [self.positions(term)]
                for p in at[np.searchsorted(at, anchor - span + 1): np.searchsorted(at, anchor + span)]
            )
            last: dict[int, int] = {}
            for p, k in window:
                last[k] = p
                if len(last) == len(terms) and p - min(last.values()) < span:
                    found.add((int(min(last.values())), int(p) + 1))
        rows = np.array(sorted(found), np.int64).reshape(-1, 2)
        if not len(rows):
            return rows
        rows = rows[self.ordinals(rows[:, 0]) == self.ordinals(rows[:, 1] - 1)]
        # A stretch that holds another one isn't among the smallest.
        rows = rows[np.diff(rows[:, 0], prepend=-1) > 0]
        inner = np.minimum.accumulate(np.append(rows[1:, 1], np.iinfo(np.int64).max)[::-1])[::-1]
        return rows[inner > rows[:, 1]]

    def ordinals(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stops, position, side="right")


def _in(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    return sorted_list[np.minimum(at, len(sorted_list) - 1)] == values


def _merged(starts: np.ndarray, length: int) -> np.ndarray:
    """Union of the stretches [s, s + length) as (start, stop) rows."""
    starts = np.unique(starts)
    new = np.append(True, np.diff(starts) > length)
    return np.stack([starts[new], np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + length], 1)


def _phrase_search(items: list[tuple[str, list[bytes]]], window: int):
    def search(segment: Segment):
        for item, words in items:
            size = min(window, len(words))
            present = np.fromiter((w in segment.size for w in words), bool, len(words))
            whole = np.convolve(present, np.ones(size, int), "valid") == size
            starts = [segment.phrase(words[i: i + size]) for i in np.flatnonzero(whole)]
            starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            if len(starts):
                yield item, _merged(starts, size)

    return search


def _near_search(items: list[tuple[str, list[bytes]]], span: int):
    def search(segment: Segment):
        for item, words in items:
            if all(w in segment.size for w in words) and len(rows := segment.near(words, span)):
                yield item, rows

    return search


def _searched(search):
    def run(table: pa.Table) -> pa.Table:
        segment = Segment(table)
        name = table.column("segment")[0].as_py()
        items, spans = [], [np.zeros((0, 2), np.int64)]
        for item, rows in search(segment):
            items += [item] * len(rows)
            spans.append(rows)
        spans = np.concatenate(spans)
        W.give_back()  # of the words looked up; the next group builds its own
        ordinal = segment.ordinals(spans[:, 0])
        base = segment.bases[ordinal] if len(ordinal) else spans[:, 0]
        return pa.table({
            "segment": pa.array([name] * len(items), pa.string()), "ordinal": pa.array(ordinal, pa.int32()), "item": pa.array(items, pa.string()),
            "start": pa.array(spans[:, 0] - base, pa.int64()), "stop": pa.array(spans[:, 1] - base, pa.int64()),
        })

    return run


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (item, text) with their words, in blocks of bounded size; rows without item or words are left out."""
    block, size = [], 0
    rows = items.select(F.col("item").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    for row in rows.filter("item IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        found = W.alnum_words(bytes(row["text"]))
        if found:
            block.append((row["item"], found))
            size += len(row["text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _passes(index: DataFrame, items: DataFrame, searcher) -> DataFrame:
    spark = index.sparkSession
    found = spark.createDataFrame([], "segment string, ordinal int, item string, start long, stop long")
    for block in blocks(items):
        wanted = {(w,) for _, words in block for w in words} | {(DOCUMENTS,)}
        needed = spark.createDataFrame([(bytearray(w),) for w, in sorted(wanted)], "word binary")  # at most BLOCK_BYTES
        rows = index.join(F.broadcast(needed), "word", "left_semi")
        hits = rows.groupBy("segment").applyInArrow(_searched(searcher(block)), found.schema)
        found = found.unionByName(cut(hits))
    return found


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(segment, ordinal, item, start, stop): stretches of words covered by ``window`` consecutive words of an item.

    An item with fewer words, but not none, is searched as a whole. Stretches of one item that touch are merged.
    """
    return _passes(index, items, lambda block: _phrase_search(block, window))


def proximity_matches(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(segment, ordinal, item, start, stop): smallest stretches of at most ``span`` words with all words of an item, in any order."""
    return _passes(index, items, lambda block: _near_search(block, span))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every row of ``docs`` (doc_id, text).

    ``items``: (item, text). A word of a document is hit when it lies in any match. Rows of equal doc_id are
    judged each on their own; items of equal id count once. Null texts have no words; items without id or words
    match nothing; without items nothing is contaminated.
    """
    index = build_index(docs)
    hits = phrase_matches(index, items, window)
    before = Window.partitionBy("segment", "ordinal").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))), F.lit(0))
    by_doc = (
        hits.withColumn("covered", covered).groupBy("segment", "ordinal")
        .agg(F.sum("covered").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        indexed_documents(index).join(by_doc, ["segment", "ordinal"], "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    )
