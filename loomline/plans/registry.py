"""Every query of the library with its SQL."""

from __future__ import annotations

from loomline.plans import queries_eval, queries_search, queries_text

_PARTS = (queries_text, queries_search, queries_eval)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
