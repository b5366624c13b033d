"""Derived tables and the registered queries."""

from __future__ import annotations


def _load() -> None:
    from . import document_queries, file_queries, flow_queries, match_queries, rule_queries, stock_queries, stream_queries  # noqa: F401


def all_queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from .registry import SQL

    _load()
    return dict(SQL)
