"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import control_queries, more_queries, record_queries, table_queries, text_queries

_PARTS = (text_queries, record_queries, more_queries, control_queries, table_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, (f, _) in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.Q.items() if sql}
