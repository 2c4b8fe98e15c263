"""Operators of training-data pipelines, and their queries. Nothing else in the library imports this package."""

from __future__ import annotations

from quern.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
