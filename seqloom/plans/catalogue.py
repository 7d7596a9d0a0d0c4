"""All queries of the sequence-graph operators and their SQL."""

from __future__ import annotations

from seqloom.plans import alignment_queries, graph_queries, profile_queries

PARTS = [profile_queries, graph_queries, alignment_queries]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
