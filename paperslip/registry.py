"""The registered queries over receipts and their oracle SQL."""

from __future__ import annotations

from paperslip.plans import field_queries, io_queries, line_queries, more_queries, record_queries, varied_queries

_PARTS = [line_queries, field_queries, record_queries, more_queries, io_queries, varied_queries]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
flagship = field_queries.flagship
