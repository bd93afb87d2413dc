"""All queries of the reference's operators and their SQL."""

from __future__ import annotations

from loomtext.plans import documents, geometry, markdown, objects, records, relations

_PLANS = (documents, relations, geometry, records, objects, markdown)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
