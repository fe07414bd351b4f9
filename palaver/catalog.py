"""Every query on the driver's tables with the DuckDB SQL that checks it."""

from __future__ import annotations

from palaver.plans import queries_calls, queries_documents, queries_insights, queries_rollups

_MODULES = [queries_calls, queries_rollups, queries_documents, queries_insights]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
