"""Registered queries over the shared test tables, each beside its SQL check."""

import importlib

from chunkloom.catalog.base import ORACLES, QUERIES  # noqa: F401

for _name in ("retrieval", "text", "indexing", "graph", "planning", "events"):
    try:
        importlib.import_module(f"chunkloom.catalog.{_name}")
    except ModuleNotFoundError:
        pass
