"""All queries of the core."""

from __future__ import annotations

from depweft.plans import adapter_queries, core_problems, graph_queries, monitor_queries, more_queries, text_queries

MODULES = [core_problems, graph_queries, text_queries, monitor_queries, adapter_queries, more_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
