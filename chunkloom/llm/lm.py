"""Scoring texts with a weighted backoff automaton over the corpus' n-grams.

Model: Dirichlet-smoothed n-grams. With c the training counts, ``P1`` the add-0.1 unigram distribution and h a context,
``P(w | h) = (c(hw) + K * P(w | shorter h)) / (c(h) + K)``, which sums to one. Contexts that occur in training are the
states of an automaton, n-grams that occur are arcs with their log-probability, and the failure arc of a state leads
to its next shorter context with weight ``log(K / (c(h) + K))``.

Distribution: texts are packed into blocks of about ``BLOCK_TOKENS`` tokens. A block sends its distinct n-grams with
their training counts, as sorted and gap-coded hashes, to buckets of the hash space; a bucket adds up the counts of all
blocks and answers each block in the order asked. So a block gets back the part of the model that its texts can
touch, builds that part of the automaton, and runs all its texts through it from left to right, one state each.
Frequent n-grams are summed in their block first and are one entry a block; nothing is broadcast or collected but
the two totals.

Words are told apart by 64-bit hashes, longer n-grams by 56 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm import words as W
from chunkloom.session import cut

ORDER = 2
STRENGTH = 50.0           # K, pseudo-counts of the shorter context
UNIT = 0.1                # pseudo-count of a word in the unigram distribution
BLOCK_TOKENS = 3 << 18
BUCKET_ENTRIES = 1 << 20
FOLDS = 10                # documents whose id hashes to fold 0 are held out
# Hashes of what no text contains as a word.
START, END = (int(h) for h in W.hashes([b"\t", b"\n"]))
BLOCK = "block string, ids array<long>, held array<boolean>, lengths array<int>, n_tokens long, n_words long, vocabulary binary, tokens binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % FOLDS == 0


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes of the least width, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _block(name: str, ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
    codes, lengths, vocabulary = W.coded(documents)
    # Frequent words get small codes, which compress well.
    order = np.argsort(-np.bincount(codes, minlength=len(vocabulary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return pa.RecordBatch.from_arrays([
        pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([[held_out(i) for i in ids]], pa.list_(pa.bool_())),
        pa.array([lengths.tolist()], pa.list_(pa.int32())), pa.array([len(codes) + len(ids)], pa.int64()), pa.array([len(vocabulary) + 1], pa.int64()),
        pa.array([W.hashes(vocabulary)[order].tobytes()], pa.binary()), pa.array([_squeezed(rank[codes])], pa.binary()),
    ], [part.split()[0] for part in BLOCK.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, total = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    documents: list[list[bytes]] = []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), W.binary_column(batch, "text")):
            found = W.space_words(text)
            ids.append(doc_id)
            documents.append(found)
            total += len(found) + 1
            if total >= BLOCK_TOKENS:
                yield _block(f"{part}-{number}", ids, documents)
                ids, documents, total, number = [], [], 0, number + 1
    if ids:
        yield _block(f"{part}-{number}", ids, documents)


class Grams:
    """All n-grams of a block, by position in the sequence ``start, words, end`` of each text, text after text."""

    def __init__(self, row: dict, order: int):
        lengths = np.array(row["lengths"], np.int64)
        hashes = np.append(np.frombuffer(row["vocabulary"], np.uint64), np.array([START, END], np.uint64))
        spans = lengths + 2
        self.first = np.cumsum(spans) - spans
        self.tokens = lengths + 1
        size = int(spans.sum())
        words = np.full(size, len(hashes) - 2, np.int64)
        words[self.first + spans - 1] = len(hashes) - 1
        inner = np.ones(size, bool)
        inner[self.first] = inner[self.first + spans - 1] = False
        words[inner] = _unsqueezed(row["tokens"]).astype(np.int64)
        place = np.arange(size) - np.repeat(self.first, spans)
        trained = np.repeat(~np.array(row["held"], bool), spans)
        self.words, self.n_words = words, len(hashes)
        # Of each order: hashes in order, one position of each, its number at every position (-1: none), training count.
        self.levels = []
        for k in range(1, order + 1):
            at = np.flatnonzero(place >= k - 1)
            h = hashes[words] if k == 1 else W.rolled(hashes[words], k)[at - k + 1] >> np.uint64(8)
            value, where, number = np.unique(h[at] if k == 1 else h, return_index=True, return_inverse=True)
            at_all = np.full(size, -1, np.int64)
            at_all[at] = number
            counts = np.bincount(number, weights=trained[at], minlength=len(value)).astype(np.int64)
            if k == 1:
                counts[value == START] = 0
            self.levels.append((value, at[where], at_all, counts))


def _bounds(value: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` (a power of two) begins in the sorted hashes, and their end."""
    lows = np.arange(buckets, dtype=np.uint64) << np.uint64(bits - buckets.bit_length() + 1) if buckets > 1 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(value, lows), len(value))


def _requests(order: int, buckets: list[int]):
    schema = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.string()), ("width", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for k, (value, _, _, counts) in enumerate(Grams(row, order).levels):
                    ends = _bounds(value, 64 if k == 0 else 56, buckets[k])
                    rows = []
                    for b in np.flatnonzero(np.diff(ends)):
                        part = value[ends[b]: ends[b + 1]]
                        gaps = np.diff(part, prepend=np.uint64(0))
                        width = max(1, (int(gaps[1:].max(initial=np.uint64(0))).bit_length() + 7) // 8)
                        rest = gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width]
                        rows.append({
                            "level": k, "bucket": int(b), "block": row["block"], "width": width,
                            "gaps": int(gaps[0]).to_bytes(8, "little") + rest.tobytes(), "counts": _squeezed(counts[ends[b]: ends[b + 1]]),
                        })
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _hashes(gaps: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(gaps, np.uint8)
    out = np.zeros(((len(raw) - 8) // width + 1, 8), np.uint8)
    out[0] = raw[:8]
    out[1:, :width] = raw[8:].reshape(-1, width)
    return np.cumsum(out.view(np.uint64).reshape(-1), dtype=np.uint64)


ANSWER = "level int, bucket int, block string, counts binary, distinct long, total long"


def _answer(table: pa.Table) -> pa.Table:
    """Training counts of one bucket over all blocks, for each block in the order it asked; one row of totals."""
    asked = table.to_pydict()
    parts = [_hashes(g, w) for g, w in zip(asked["gaps"], asked["width"])]
    _, number = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([_unsqueezed(c) for c in asked["counts"]])).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    counts = [_squeezed(total[number[e - len(p): e]]) for e, p in zip(ends, parts)]
    n = len(parts)
    return pa.table({
        "level": pa.array(asked["level"] + asked["level"][:1], pa.int32()), "bucket": pa.array(asked["bucket"] + asked["bucket"][:1], pa.int32()),
        "block": pa.array(asked["block"] + [None], pa.string()), "counts": pa.array(counts + [None], pa.binary()),
        "distinct": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "total": pa.array([None] * n + [int(total.sum())], pa.int64()),
    })


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block that the training texts contain."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, distinct: int, strength: float):
        self.n_words, order = grams.n_words, len(counts)
        numbers = [level[2] for level in grams.levels]
        unigram = np.zeros(self.n_words)
        value, where, _, _ = grams.levels[0]
        word_of = grams.words[where]
        unigram[word_of] = counts[0]
        denominator = tokens + UNIT * (distinct + 1)
        probability = (unigram + UNIT) / denominator
        self.known, self.base = unigram > 0, np.log10(probability)
        # A text starts in a context that is seen once for each training text, as its end is.
        context = counts[0].astype(float)
        context[value == START] = context[value == END].sum()
        seen = [context > 0] + [c > 0 for c in counts[1:]]
        sizes = [len(c) for c in counts[: max(order - 1, 1)]]
        offsets = np.cumsum([1] + sizes)
        states = int(offsets[-1])
        self.fail, self.backoff = np.zeros(states, np.int64), np.zeros(states)
        state = lambda k, g: np.where(seen[k][g], offsets[k] + g, 0)
        self.root_next = np.zeros(self.n_words, np.int64)
        if order > 1:
            self.root_next[word_of] = state(0, np.arange(len(value)))
        keys, logs, following = [], [], []
        lower = probability[word_of]
        mass = context
        for k in range(1, order):
            at = grams.levels[k][1]
            before, suffix = numbers[k - 1][at - 1], numbers[k - 1][at]
            share = (counts[k] + strength * lower[suffix]) / (mass[before] + strength)
            own = np.flatnonzero(seen[k])
            keys.append((offsets[k - 1] + before[own]) * self.n_words + grams.words[at[own]])
            logs.append(np.log10(share[own]))
            following.append(offsets[k] + own if k < order - 1 else state(k - 1, suffix[own]))
            here = offsets[k - 1] + np.arange(len(mass))
            self.backoff[here] = np.log10(strength / (mass + strength))
            if k < order - 1:
                self.fail[offsets[k] + np.arange(len(counts[k]))] = state(k - 1, suffix)
            lower, mass = share, counts[k].astype(float)
        self.start = int(state(0, np.flatnonzero(value == START))[0]) if order > 1 and len(value) else 0
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        rank = np.argsort(self.keys)
        self.keys = self.keys[rank]
        self.logs = (np.concatenate(logs) if logs else np.zeros(0))[rank]
        self.following = (np.concatenate(following) if following else np.zeros(0, np.int64))[rank]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and next state of each text that is in ``state`` and reads ``word``."""
        weight, following = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo, at = np.arange(len(state)), state
        while len(todo):
            root = at == 0
            done = todo[root]
            weight[done] += self.base[word[done]]
            following[done] = self.root_next[word[done]]
            todo, at = todo[~root], at[~root]
            if not len(todo):
                break
            key = at * self.n_words + word[todo]
            arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), bool)
            weight[todo[hit]] += self.logs[arc[hit]]
            following[todo[hit]] = self.following[arc[hit]]
            todo, at = todo[~hit], at[~hit]
            weight[todo] += self.backoff[at]
            at = self.fail[at]
        return weight, following

    def run(self, grams: Grams) -> np.ndarray:
        """Log-probability of each text. All texts advance together, the longer ones go on when others have ended."""
        order = np.argsort(-grams.tokens, kind="stable")
        first, tokens = grams.first[order] + 1, grams.tokens[order]
        total, state = np.zeros(len(order)), np.full(len(order), self.start)
        live = np.searchsorted(-tokens, -np.arange(int(tokens.max(initial=0))), side="left")
        for t, n in enumerate(live):
            weight, state = self.step(state[:n], grams.words[first[:n] + t])
            total[:n] += weight
        out = np.empty(len(order))
        out[order] = total
        return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, tokens: int, distinct: int, strength: float):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        grams = Grams(row, order)
        counts = []
        for k in range(order):
            mine = answers.filter(pa.compute.equal(answers.column("level"), k)).sort_by("bucket").column("counts").to_pylist()
            counts.append(np.concatenate([_unsqueezed(c) for c in mine]).astype(np.int64))
        automaton = Automaton(grams, counts, tokens, distinct, strength)
        owner = np.repeat(np.arange(len(grams.tokens)), grams.tokens + 1)
        inside = np.ones(len(owner), bool)
        inside[grams.first] = False
        word = grams.words[inside]
        per = lambda x: np.bincount(owner[inside], weights=x, minlength=len(grams.tokens))
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(grams.tokens, pa.int64()),
            "n_known": pa.array(per(automaton.known[word]).astype(np.int64)), "train_tokens": pa.array([tokens] * len(grams.tokens), pa.int64()),
            "base_score": pa.array(per(automaton.base[word])), "score": pa.array(automaton.run(grams)),
        })

    return run


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """Base and model log10-probability of every row of ``docs`` (doc_id, text), learned from those not held out.

    A null or empty text is its end alone. Repeated rows count and are scored each; a row without doc_id counts as
    the id of no characters, which is held out. Without training texts every word has the unigram prior.
    """
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    blocks = cut(source.mapInArrow(_pack, BLOCK))
    size = blocks.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("w")).first()
    entries = [size["w"] or 0] + [size["n"] or 0] * (order - 1)
    buckets = [1 << max(0, (n // BUCKET_ENTRIES).bit_length()) for n in entries]
    asked = blocks.mapInArrow(_requests(order, buckets), "level int, bucket int, block string, width int, gaps binary, counts binary")
    answers = cut(asked.groupBy("level", "bucket").applyInArrow(_answer, ANSWER))
    totals = answers.filter("block IS NULL AND level = 0").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    scorer = _score(order, totals["n"] or 0, totals["v"] or 0, strength)
    return blocks.groupBy("block").cogroup(answers.filter("block IS NOT NULL").groupBy("block")).applyInArrow(scorer, SCORED)
