"""Quality rules: base rules, a hashed n-gram log-likelihood ratio, and the worst window of words shunned by trusted text.

Two multinomials over hashed word unigrams and bigrams are counted: one over all documents (raw), one over trusted
documents (labelled good and not toxic). The score of a document is the mean, over its n-grams, of
``log(p_trusted / p_raw)``, or that of its worst window if it is lower; a document is kept when it passes the base
rules and its score reaches ``THRESHOLD``.
A document's own n-grams are taken out of both counts before it is scored, so that neither a small corpus nor being
in the trusted sample moves its score; cells seen too rarely to tell are pulled to a ratio of one by ``SMOOTHING``.

A few insults don't move a mean over all n-grams. So the same ratio is also taken of words by the number of documents
that hold them (one text full of a word is one document), and words that trusted documents hold less than half as
often as raw ones count with it. A window of ``WINDOW`` words slides over the document; its value is the mean ratio of
such words over its length. The lowest value, on the scale on which ``WORST`` is ``THRESHOLD``, is the score if it is
lower than the mean. Each word has a cell in two tables by independent hash bits
and counts with its milder ratio, so a clean word that shares one cell with an insult isn't taken for it.

Raw counts come from every document. The trusted side is a bounded sample of labelled ids (``SAMPLE`` ids with the
smallest hashes), small enough to be broadcast. The model has ``CELLS`` cells whatever the corpus size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm import words as W

BITS = 18
BUCKETS = 1 << BITS
CELLS = 3 * BUCKETS    # n-grams by occurrences, then two tables of words by documents
SAMPLE = 20_000        # trusted labelled documents that fit the target model; ids only are broadcast (about 0.5 MB)
SMOOTHING = 5.0        # pseudo-count of each cell, in trusted n-grams
THRESHOLD = -0.2       # mean log-likelihood ratio in nats per n-gram
WINDOW = 50            # words of a sliding window
RARER = -0.7           # log ratio below which a word counts in its window: under half as frequent in trusted documents
WORST = -0.035         # mean over a window of the log ratios of its rarer words
PUNCTUATION = b".,;:!?\"'()[]"
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 3


def cells(codes: np.ndarray, lengths: np.ndarray, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every unigram and of every bigram inside a document, and the document each belongs to."""
    h = W.finish(W.hashes(vocabulary))[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    same = owner[1:] == owner[:-1]
    pairs = W.finish(h[:-1] * W.MIX[0] + h[1:])[same] if len(h) > 1 else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    return (
        np.concatenate([h >> shift, pairs >> shift]).astype(np.int64),
        np.concatenate([owner, owner[1:][same] if len(h) > 1 else owner[:0]]),
    )


def word_pairs(codes: np.ndarray, lengths: np.ndarray, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, word) pairs, words without punctuation around them: document, cells in both tables, and the pair of each word in order."""
    words = pa.array([w.strip(PUNCTUATION) for w in vocabulary], pa.binary()).dictionary_encode()
    h = W.finish(W.hashes(words.dictionary.to_pylist()))
    n = max(len(h), 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    key, pair = np.unique(owner * n + words.indices.to_numpy().astype(np.int64)[codes], return_inverse=True)
    at = h[key % n]
    tables = np.stack([at >> np.uint64(64 - BITS), ((at >> np.uint64(64 - 2 * BITS)) & np.uint64(BUCKETS - 1)) + np.uint64(BUCKETS)])
    return key // n, tables.astype(np.int64) + BUCKETS, pair


def repeated_words(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: words inside 3-word windows that occur twice or more in it."""
    n, size = len(codes), REPEAT_WINDOW
    out = np.zeros(len(lengths), np.int64)
    if n < size:
        return out
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[size - 1:] == owner[: n - size + 1]
    c = codes.astype(np.uint64)
    key = owner[: n - size + 1].astype(np.uint64)
    for i in range(size):
        key = W.finish(key * W.MIX[0] + c[i: n - size + 1 + i])
    at = np.flatnonzero(inside)
    _, inverse, counts = np.unique(key[at], return_inverse=True, return_counts=True)
    starts = at[counts[inverse] > 1]
    hit = np.zeros(n, bool)
    for i in range(size):
        hit[starts + i] = True
    np.add.at(out, owner[hit], 1)
    return out


def duplicate_lines(text: bytes | None) -> int:
    lines = [line for line in text.split(b"\n") if line.split()] if text else []
    return len(lines) - len(set(lines))


def word_characters(text: bytes | None) -> int:
    """Code points outside white space."""
    if not text:
        return 0
    dense = text.translate(None, b" \t\n\v\f\r")
    return len(dense) - len(dense.translate(None, bytes(range(128)) + bytes(range(192, 256))))


def _count(batches):
    raw, trusted = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for batch in batches:
        texts, flags = W.binary_column(batch, "text"), np.array(batch.column(1).to_pylist(), bool)
        for a, b in W.groups(texts):
            coded = W.coded([W.space_words(t) for t in texts[a:b]])
            where, owner = cells(*coded)
            doc, tables, _ = word_pairs(*coded)
            mine = flags[a:b]
            raw += np.bincount(where, minlength=CELLS) + np.bincount(tables.ravel(), minlength=CELLS)
            trusted += np.bincount(where[mine[owner]], minlength=CELLS) + np.bincount(tables[:, mine[doc]].ravel(), minlength=CELLS)
    at = np.flatnonzero(raw)
    for i in range(0, len(at), 50_000):
        part = at[i: i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(trusted[part])], ["cell", "raw", "trusted"])


def trusted_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` ids of documents labelled good and not toxic in all their labels, by smallest hash."""
    return (
        labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .filter("q = 1 AND t = 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_trusted"))
    )


def _flagged(docs: DataFrame, trusted: DataFrame, columns: list) -> DataFrame:
    """``columns`` and whether the row is in the trusted sample, which holds at most SAMPLE ids."""
    hit = docs.join(F.broadcast(trusted), docs["doc_id"] == trusted["_trusted"], "left")
    return hit.select(*columns, F.col("_trusted").isNotNull().alias("_flag"))


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Counts of each of the ``CELLS`` over all documents (row 0) and over the trusted ones (row 1)."""
    counted = (
        _flagged(docs, trusted, [docs["text"].cast("binary").alias("text")])
        .mapInArrow(W.tidy(_count), "cell int, raw long, trusted long")
        .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .toArrow()  # at most CELLS rows
    )
    model = np.zeros((2, CELLS))
    model[:, counted.column("cell").to_numpy()] = counted.column("raw").to_numpy(), counted.column("trusted").to_numpy()
    return model


def ratio_scores(where: np.ndarray, owner: np.ndarray, flags: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio of each document, its own n-grams left out of the counts; 0 without n-grams.

    With t of T trusted and r of R raw n-grams in a cell: ``log((t + m) / (r * T / R + m))``, m the smoothing.
    """
    total = model[:, :BUCKETS].sum(axis=1)
    key, count = np.unique(owner * BUCKETS + where, return_counts=True)
    doc, cell = key // BUCKETS, key % BUCKETS
    size = np.bincount(owner, minlength=len(flags))
    t = model[1][cell] - count * flags[doc]
    trusted = np.maximum(total[1] - size * flags, 0)
    share = trusted / np.maximum(total[0] - size, 1)
    r = (model[0][cell] - count) * share[doc]
    ratio = np.log((t + SMOOTHING) / (r + SMOOTHING))
    return np.bincount(doc, weights=ratio * count, minlength=len(flags)) / np.maximum(size, 1)


def worst_windows(lengths: np.ndarray, flags: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], model: np.ndarray) -> np.ndarray:
    """Lowest mean over ``WINDOW`` words of the ratios of rarer words, the document itself left out of the counts; 0 without any.

    The mean is over ``WINDOW`` words in shorter texts too. Ratios are summed in whole millionths, so that the sums
    don't depend on the documents of a group.
    """
    doc, tables, pair = pairs
    total = model[:, BUCKETS:].sum(axis=1) / 2  # a pair is in both tables
    size = np.bincount(doc, minlength=len(flags))
    share = (np.maximum(total[1] - size * flags, 0) / np.maximum(total[0] - size, 1))[doc]
    ratio = np.log((model[1][tables] - flags[doc] + SMOOTHING) / ((model[0][tables] - 1) * share + SMOOTHING)).max(axis=0)
    rarer = np.where(ratio < RARER, np.rint(1e6 * ratio), 0).astype(np.int64)[pair]
    sums = np.concatenate([[0], np.cumsum(rarer)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(len(owner))
    worst = np.zeros(len(lengths), np.int64)
    np.minimum.at(worst, owner, sums[np.minimum(start + WINDOW, np.cumsum(lengths)[owner])] - sums[start])
    return worst / (1e6 * WINDOW)


def lower_of(means: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """The mean ratio, or the worst window's on its scale where that is lower; a text without rarer words has no window."""
    return np.where(worst < 0, np.minimum(means, worst * (THRESHOLD / WORST)), means)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, worst double"


def _scorer(model: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = W.binary_column(batch, "text")
            flags = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            parts = []
            for a, b in W.groups(texts):
                part = texts[a:b]
                codes, lengths, vocabulary = W.coded([W.space_words(t, lower=False) for t in part])
                # Lower-casing only merges codes, so the texts are split once.
                lower = [w.translate(W.UPPER) for w in vocabulary]
                where, owner = cells(codes, lengths, lower)
                worst = worst_windows(lengths, flags[a:b], word_pairs(codes, lengths, lower), model)
                symbols = np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in part), np.int64, b - a)
                parts.append((
                    lengths, np.fromiter(map(word_characters, part), np.int64, b - a), symbols,
                    np.fromiter(map(duplicate_lines, part), np.int64, b - a), repeated_words(codes, lengths),
                    lower_of(ratio_scores(where, owner, flags[a:b], model), worst), worst,
                ))
            measures = [pa.array(np.concatenate(x)) for x in zip(*parts)] or [pa.array([], pa.int64())] * 5 + [pa.array([], pa.float64())] * 2
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(kept + measures, names + [m.split()[0] for m in MEASURES.split(", ")])

    return run


def measure(docs: DataFrame, model: np.ndarray, trusted: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of every row with the base measures, ``base_failed``, ``score``, ``worst`` and ``kept``.

    A null or empty text has no words and fails the base rule. Repeated rows are measured each on its own.
    Columns other than ``keep`` and ``text`` are not read. A document at the threshold is kept. Without trusted
    documents every score is 0.
    """
    columns = [docs[f"`{c}`"] for c in keep] + ([] if "text" in keep else [docs["text"].cast("binary").alias("text")])
    source = _flagged(docs, trusted, columns)
    names = [f.name for f in source.schema.fields if f.name in keep]
    schema = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names)
    rows = source.mapInArrow(W.tidy(_scorer(model, names)), f"{schema}, {MEASURES}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with exactly their columns, whatever else these are called."""
    trusted = trusted_ids(labels)
    model = fit(docs, trusted)
    names = {c: c if c in ("doc_id", "text") else f"_column{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()])
    rows = measure(plain, model, trusted, list(names.values())).filter("kept")
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])
