"""All queries of the package, by name."""

from __future__ import annotations

from plumbline.plans import diagnostic_queries, retrieval_queries, service_queries, stream_queries, table_queries, text_queries

MODULES = (table_queries, text_queries, retrieval_queries, diagnostic_queries, service_queries, stream_queries)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
