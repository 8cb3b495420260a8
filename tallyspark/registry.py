"""All registered queries over the reference's own operators, and the SQL that checks them."""

from __future__ import annotations

from tallyspark.plans import catalog_queries, learner_queries, record_queries, resolver_queries, text_queries

_MODULES = (resolver_queries, record_queries, learner_queries, catalog_queries, text_queries)

QUERIES: dict = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
