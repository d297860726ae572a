"""Names every query of the library and its oracle SQL."""

from __future__ import annotations

from tidemark.plans import checked_queries, clock_queries, grid_queries, ordered_queries, release_queries, series_queries, source_queries, status_queries, store_queries, synthesis_queries, table_queries

MODULES = [series_queries, table_queries, synthesis_queries, status_queries, release_queries, store_queries, ordered_queries, clock_queries, grid_queries, checked_queries, source_queries]


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
