"""Registered queries over the driver's tables, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from . import aggregates, functions, joins, pages

MODULES = (functions, pages, joins, aggregates)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
