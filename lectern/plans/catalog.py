"""All registered queries of the engine's own operators, with their SQL where SQL can express them."""

from __future__ import annotations

from lectern.plans import compare, ingest, records, review, search, statements

_FAMILIES = (search, records, ingest, statements, review, compare)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
