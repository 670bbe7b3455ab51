"""All registered queries of the engine with their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("vector_queries", "text_queries", "graph_queries", "record_queries", "search_queries", "people_queries", "store_queries", "export_queries", "works_queries", "match_queries", "fleet_queries")


def _collect(which: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), which)
    return found


def queries() -> dict:
    return _collect("Q")


def oracle_sql() -> dict:
    return _collect("S")
