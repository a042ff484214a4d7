"""Collects the queries and their SQL from the plan modules."""

from __future__ import annotations

from strandline.plans import family_queries, graph_queries, io_queries, planted_queries, sequence_queries, tool_queries

MODULES = (family_queries, graph_queries, tool_queries, sequence_queries, planted_queries, io_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
