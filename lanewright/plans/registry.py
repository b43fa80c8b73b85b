"""All queries of the core library and their SQL counterparts."""

from __future__ import annotations

from lanewright.plans import build_queries, cleaning_queries, model_queries, nested_queries

PARTS = (nested_queries, cleaning_queries, model_queries, build_queries)


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for part in PARTS for name, s in part.SQL.items()}
