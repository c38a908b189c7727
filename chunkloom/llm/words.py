"""Words, codes and hashes of whole texts, as numpy arrays inside tasks.

Texts reach Python as UTF-8 bytes: translating and splitting bytes is the fastest tokenizer at hand, and for the
two word classes used here it equals the regular expressions over characters. Work goes by groups of documents of
bounded size, so the memory of a task does not follow the size of an Arrow batch; only a single very long text can
pass the bound, and then by its own length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, functions as F

GROUP_BYTES = 1 << 20

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# A-Z lower-cased; every ASCII character that is no digit or letter becomes a blank; bytes of other characters stay.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def give_back() -> None:
    """Return this process's free memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, which gives memory back at its end: Python workers outlive their tasks and wait beside later ones."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def lower_ascii(column: Column | str) -> Column:
    """``column`` with A-Z lower-cased and all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text."""
    if not text:
        return []
    return (text.translate(UPPER) if lower else text).split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(ALNUM).split() if text else []


def groups(texts: list[bytes | None], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``limit`` bytes together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def coded(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words in order, words per document, and the distinct words by code."""
    lengths = np.fromiter((len(d) for d in documents), np.int64, len(documents))
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int32), lengths, []
    column = pa.array(chain.from_iterable(documents), pa.binary(), size=total).dictionary_encode()
    return column.indices.to_numpy(), lengths, column.dictionary.to_pylist()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def finish(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def rolled(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each ``size`` consecutive words; with fewer words, one for the whole sequence."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64) * MIX[0]
    for i in range(size):
        out = finish(out * MIX[0] + word_hashes[i: n - size + 1 + i])
    return out


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def blobs(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Binary column over the bytes of ``values``; row i ends before the element ``stops[i]``."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.asarray(stops, np.int64) * width])
    return pa.Array.from_buffers(
        pa.large_binary(), len(stops), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes of the least width, after one byte that tells it: high planes compress well."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def widen(packed: bytes) -> np.ndarray:
    """The integers of :func:`narrow`."""
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<i8").reshape(-1)
