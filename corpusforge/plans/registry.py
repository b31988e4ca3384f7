"""Names of the engine's queries, with the SQL that gives the same rows."""

from __future__ import annotations

from . import event_queries, extra_queries, pair_queries, record_queries, service_queries, span_queries, text_queries

_ALL = text_queries.QUERIES | pair_queries.QUERIES | record_queries.QUERIES | span_queries.QUERIES | event_queries.QUERIES | extra_queries.QUERIES | service_queries.QUERIES
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
