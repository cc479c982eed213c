"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import detail_queries, export_queries, extract_queries, quality_queries, table_queries, text_queries, usage_queries

MODULES = [usage_queries, text_queries, extract_queries, table_queries, quality_queries, export_queries, detail_queries]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
