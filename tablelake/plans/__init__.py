"""Runnable queries over a folder of tables."""
from __future__ import annotations

import importlib

_MODULES = (
    "queries_sql", "queries_catalog", "queries_ingest", "queries_text", "queries_cells", "queries_questions",
    "queries_pages", "queries_dataset",
)


def load_queries():
    """`(queries, equivalent SQL)` by name."""
    from tablelake.plans import registry

    for name in _MODULES:
        importlib.import_module(f"tablelake.plans.{name}")
    return registry.QUERIES, registry.ORACLES
