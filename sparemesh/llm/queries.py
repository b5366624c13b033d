"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame`` under a name."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _load() -> None:
    from . import operator_queries  # noqa: F401


def llm_queries() -> dict:
    _load()
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
