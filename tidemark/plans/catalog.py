"""All queries of the core and their SQL."""

from __future__ import annotations

from tidemark.plans import index_queries, measurements, profiles, reference, tools


def queries() -> dict:
    return reference.QUERIES | index_queries.QUERIES | profiles.QUERIES | tools.QUERIES | measurements.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference.SQL | index_queries.SQL | profiles.SQL | tools.SQL | measurements.SQL
