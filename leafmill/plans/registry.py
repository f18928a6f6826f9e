"""The queries by name and their SQL."""

from __future__ import annotations

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its name, with the SQL that says the same."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
