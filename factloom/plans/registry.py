"""All queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_LIBRARY = ("text_queries", "evidence_queries", "model_queries", "source_queries")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; ``sql`` is what DuckDB runs to give the same rows."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _loaded() -> None:
    for name in _LIBRARY:
        importlib.import_module(f"factloom.plans.{name}")


def queries() -> dict:
    _loaded()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _loaded()
    return _SQL
