"""Token counts of whole texts as a tokenizer library gives them, huge texts in overlapping chunks.

Proof that is used throughout, for byte-level BPE with the usual splitting pattern: no alternative of the pattern
matches a character outside white space followed by white space, so between two such characters there is always a
token boundary, whatever stands further left or right. Positions before ASCII white space and after a character that
is no white space in Unicode are called stable.

Texts of up to ``CHUNK`` characters are cut at stable positions, and each distinct piece is encoded once by the
library. Longer ones are cut into chunks that overlap by ``OVERLAP`` characters, and the chunks are dealt to all
tasks. Each chunk is encoded whole, with offsets; neighbours are spliced at the first position of their overlap that
is stable and a token boundary in both encodings. Where an overlap holds none, the document is done again with an
overlap four times as wide, in the end as one chunk.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm import words as W
from chunkloom.session import cut

CHUNK = 1 << 15
OVERLAP = 1 << 10
LIMIT = 1024
MEMO = 1 << 19      # distinct pieces a task remembers
PIECE = re.compile(rb"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
# White space outside ASCII, as UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")


def _tokenizer(serialised: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(serialised)


class Counter:
    """Counts of short texts with a memo of pieces; every count comes from the library."""

    def __init__(self, tokenizer):
        self.tokenizer, self.memo = tokenizer, {}

    def _encoded(self, texts: list[bytes]) -> list[int]:
        out = []
        for i in range(0, len(texts), 5000):
            part = [t.decode("utf-8", "replace") for t in texts[i: i + 5000]]
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        pieces = [[] if not t else [t] if WIDE_SPACE.search(t) else PIECE.findall(t) for t in texts]
        codes, lengths, vocabulary = W.coded(pieces)
        new = [p for p in vocabulary if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, vocabulary
        self.memo.update(zip(new, self._encoded(new)))
        each = np.fromiter(map(self.memo.__getitem__, vocabulary), np.int64, len(vocabulary))
        owner = np.repeat(np.arange(len(texts)), lengths)
        return np.bincount(owner, weights=each[codes] if len(codes) else None, minlength=len(texts)).astype(np.int64)


def _short(serialised: str):
    def run(batches):
        counter = Counter(_tokenizer(serialised))
        for batch in batches:
            texts = W.binary_column(batch, "text")
            found = [counter.counts(texts[a:b]) for a, b in W.groups(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), W.binary_column(batch, "text")):
                text = data.decode("utf-8", "replace")
                count = max(1, -(-(len(text) - overlap) // chunk))
                for i in range(count):
                    stop = len(text) if i == count - 1 else (i + 1) * chunk + overlap
                    yield pa.RecordBatch.from_pylist(
                        [{"key": key, "number": i, "start": i * chunk, "last": i == count - 1, "piece": text[i * chunk: stop]}],
                        pa.schema([("key", pa.string()), ("number", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())]),
                    )

    return run


def boundaries(text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable positions of ``text`` that are token boundaries in its encoding, and the tokens before each."""
    stable = np.fromiter((m.start() for m in STABLE.finditer(text)), np.int64)
    before = np.searchsorted(offsets[:, 0], stable, side="left")
    # The tokens before the position end there, and the next one starts there.
    aligned = (before > 0) & (before < len(offsets))
    aligned[aligned] = (offsets[before[aligned] - 1, 1] <= stable[aligned]) & (offsets[before[aligned], 0] == stable[aligned])
    return stable[aligned], before[aligned]


def _encode(serialised: str, overlap: int):
    def run(batches):
        tokenizer = _tokenizer(serialised)
        for batch in batches:
            for row in batch.to_pylist():
                text = row["piece"]
                encoding = tokenizer.encode(text, add_special_tokens=False)
                at, before = boundaries(text, np.array(encoding.offsets, np.int64).reshape(-1, 2))
                left = (at < overlap) & (row["number"] > 0)
                right = (at >= len(text) - overlap) & (not row["last"])
                lists = lambda which: ((at[which] + row["start"]).tolist(), before[which].tolist())
                (lp, ln), (rp, rn) = lists(left), lists(right)
                yield pa.RecordBatch.from_pylist([{
                    "key": row["key"], "number": row["number"], "last": row["last"], "tokens": len(encoding.ids),
                    "left_at": lp, "left_before": ln, "right_at": rp, "right_before": rn,
                }], ENCODED)

    return run


ENCODED = pa.schema([("key", pa.string()), ("number", pa.int32()), ("last", pa.bool_()), ("tokens", pa.int64())]
                    + [(n, pa.list_(pa.int64())) for n in ("left_at", "left_before", "right_at", "right_before")])
ENCODED_SQL = ("key string, number int, last boolean, tokens long, left_at array<long>, left_before array<long>, "
               "right_at array<long>, right_before array<long>")


def spliced(texts: DataFrame, serialised: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of each text of ``texts`` (key, text); null where some overlap holds no common boundary."""
    tasks = texts.sparkSession.sparkContext.defaultParallelism * 4
    pieces = texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(
        _chunks(chunk, overlap), "key string, number int, start long, last boolean, piece string"
    )
    encoded = cut(pieces.repartition(tasks, "key", "number").mapInArrow(_encode(serialised, overlap), ENCODED_SQL))
    after = encoded.select("key", (F.col("number") - 1).alias("number"), F.col("left_at").alias("next_at"), F.col("left_before").alias("next_before"))
    met = encoded.join(after, ["key", "number"], "left").withColumn("splice", F.get(F.array_intersect("right_at", "next_at"), F.lit(0)))
    taken = F.when(F.col("last"), F.col("tokens")).otherwise(F.element_at("right_before", F.array_position("right_at", F.col("splice")).cast("int")))
    skipped = F.when(F.col("last"), 0).otherwise(F.element_at("next_before", F.array_position("next_at", F.col("splice")).cast("int")))
    return met.groupBy("key").agg(
        F.when(F.bool_and(F.col("last") | F.col("splice").isNotNull()), F.sum(F.when(F.col("last") | F.col("splice").isNotNull(), taken - skipped))).alias("n_tokens")
    )


def long_counts(texts: DataFrame, serialised: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of each text, however long."""
    done, open_texts = [], texts
    while True:
        counted = cut(spliced(open_texts, serialised, chunk, overlap))
        done.append(counted.filter("n_tokens IS NOT NULL"))
        failed = counted.filter("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        open_texts, overlap = texts.join(failed, "key", "left_semi"), overlap * 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def token_counts(docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; ``tokenizer`` is the path of its file.

    The file is read on the driver and shipped with the tasks. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows are counted each; a long text is encoded once however often it occurs.
    """
    with open(tokenizer, encoding="utf-8") as file:
        serialised = file.read()
    rows = docs.select(docs["doc_id"], docs["text"])
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.filter(~is_long).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _short(serialised), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    )
    long = rows.filter(is_long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    counted = long_counts(long.groupBy("key").agg(F.first("text").alias("text")), serialised, chunk, overlap)
    joined = long.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
