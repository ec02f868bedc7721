"""All registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from . import catalog_plans, fold_plans, graph_plans, log_plans, text_plans

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (log_plans, fold_plans, graph_plans, catalog_plans, text_plans):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
