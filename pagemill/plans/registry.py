"""All queries of the library proper by name, and their SQL."""

from __future__ import annotations

from pagemill.plans import page_queries, planning_queries, text_queries

_MODULES = (planning_queries, text_queries, page_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
