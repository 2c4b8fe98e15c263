"""All queries of the reference's own operators, and their SQL."""

from __future__ import annotations

from quern.plans import activity, catalogue, fusion, keywords, lookups, onboarding, retrieval, selection, streams

MODULES = (retrieval, catalogue, keywords, selection, activity, fusion, onboarding, lookups, streams)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
