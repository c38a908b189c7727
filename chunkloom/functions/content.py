"""Expressions over file bytes, text, vectors and delivery fields."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from chunkloom.schemas import BINARY_WINDOW

# Any character that is not white space; written so that Java and RE2 read it alike.
NONBLANK = r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"

# Token and import patterns.
TOKEN = r"[a-z0-9_]+"
IMPORT_TOKEN = r"""["']([^"']+)["']|(?:from|import)\s+([\p{L}\p{N}_.]+)"""
BRANCH_PREFIX = "refs/heads/"
SIGNATURE_PREFIX = "sha256="


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def looks_binary(content: Column | str) -> Column:
    """A NUL byte in the first 8 KiB of the raw bytes."""
    return F.contains(F.substring(_col(content), 1, BINARY_WINDOW), F.lit(b"\x00"))


def decode_lenient(content: Column | str) -> Column:
    """UTF-8 text of raw bytes; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(_col(content).cast("string"))


def content_hash(value: Column | str) -> Column:
    return F.sha2(_col(value), 256)


def tokenize(text: Column | str) -> Column:
    """Lexical tokens of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def branch_of(ref: Column | str) -> Column:
    """Branch name of a branch ref, null for tags and anything else."""
    r = _col(ref)
    return F.when(r.startswith(BRANCH_PREFIX), F.substring(r, len(BRANCH_PREFIX) + 1, 100_000))


def sign(body: Column | str, secret: str) -> Column:
    """HMAC-SHA256 header value of a raw body.

    The two padded key blocks are literals made on the driver, so it is two nested hashes and needs
    no Python worker.
    """
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, _col(body)), 256))
    return F.concat(F.lit(SIGNATURE_PREFIX), F.sha2(F.concat(outer_pad, inner), 256))


def signature_valid(body: Column | str, header: Column | str, secret: str | None) -> Column:
    """Check a signature header; false when secret or header is missing or malformed."""
    if not secret:
        return F.lit(False)
    return F.coalesce(_col(header) == sign(body, secret), F.lit(False))


def parse_ts(value: Column | str) -> Column:
    """ISO timestamp with or without `Z`; null for null or malformed input."""
    return F.try_to_timestamp(_col(value))


def label_names(labels: Column | str) -> Column:
    """Names from a list of label objects (as JSON text) or plain strings."""
    return F.transform(
        F.coalesce(_col(labels), F.array().cast("array<string>")),
        lambda x: F.coalesce(F.get_json_object(x, "$.name"), x),
    )


def citation(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.format_string("%s:%d-%d", _col(path), _col(start), _col(end))


def label(symbol: Column | str, kind: Column | str) -> Column:
    """Display label: the symbol, or the kind where there is none."""
    return F.coalesce(F.nullif(_col(symbol), F.lit("")), _col(kind))


def import_tokens(content: Column | str, first: int | None = None) -> Column:
    """Module tokens of an import statement (only the ``first`` ones): quoted strings and dotted names, in text order."""
    hits = F.regexp_extract_all(_col(content), F.lit(IMPORT_TOKEN), F.lit(0))
    hits = hits if first is None else F.slice(hits, 1, first)
    # A hit is a quoted string, or a keyword, white space and a name that has none.
    return F.transform(
        hits,
        lambda m: F.when(F.substring(m, 1, 1).isin('"', "'"), m.substr(F.lit(2), F.length(m) - 2))
        .otherwise(F.substring_index(F.translate(m, "\t\n\x0b\f\r", "     "), " ", -1)),
    )


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two vectors (row-level use; batches go through ``operators.dense``)."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
