"""The library's queries over the driver's tables and their SQL for DuckDB, gathered from its modules."""

from __future__ import annotations

from lectern import queries_books, queries_html, queries_more, queries_text

_MODULES = (queries_html, queries_text, queries_books, queries_more)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
