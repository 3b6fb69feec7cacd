"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = (
    "spend_queries", "lifecycle_queries", "operations_queries", "extraction_queries", "quality_queries",
    "curation_queries", "category_queries", "stream_queries", "line_queries", "benchmark_queries", "corpus_queries",
)


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
