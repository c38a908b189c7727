"""Expressions over paths, module names and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File extension to language.
EXTENSIONS = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".md": "markdown",
    ".markdown": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
}

# Fixed value: the address forms that carry an owner/repo name.
FULL_NAME = r"github\.com[:/]+([^/]+)/([^/]+?)(?:\.git)?/?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_language(path: Column | str) -> Column:
    """Language of a path by its last suffix, null when unknown. A bare dot-file has no suffix."""
    suffix = F.regexp_extract(F.lower(_col(path)), r"[^/](\.[^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, suffix)


def is_safe_relative_path(path: Column | str) -> Column:
    """True for a non-empty relative path without `~`, `..` or empty segments."""
    p = _col(path)
    parts = F.split(p, "/", -1)
    unsafe = (
        (p == "")
        | p.startswith("/")
        | p.startswith("~")
        | F.array_contains(parts, "..")
        | F.array_contains(parts, "")
    )
    return F.coalesce(~unsafe, F.lit(False))


def path_stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    name = F.regexp_extract(_col(path), r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def module_stem(token: Column | str) -> Column:
    """Last non-empty segment of a module name, dots counting as separators."""
    path = F.translate(_col(token), ".", "/")
    # A line break at the very end is left over by the pattern, so such names keep it.
    broken = F.substring(path, -1, 1).isin("\n", "\r", "\x85", "\u2028", "\u2029")
    return F.when(broken, F.regexp_extract(path, r"(?<![^/])([^/]+)/*$", 1)).otherwise(
        F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    )


def repository_name(url: Column | str) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(_col(url), r"/+$", ""), r"\.git$", "")
    return F.coalesce(F.nullif(F.regexp_extract(cleaned, r"([^/]*)$", 1), F.lit("")), cleaned)


def full_name(url: Column | str) -> Column:
    """`owner/repo` of a hosted repository address, else null."""
    u = _col(url)
    owner = F.regexp_extract(u, FULL_NAME, 1)
    name = F.regexp_extract(u, FULL_NAME, 2)
    return F.when(owner != "", F.concat(owner, F.lit("/"), name))
