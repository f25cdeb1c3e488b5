"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from sheaf.plans import answer_queries, chunk_queries, data_queries, document_queries, html_queries, page_queries, record_queries, run_queries

MODULES = (answer_queries, data_queries, page_queries, chunk_queries, record_queries, document_queries, html_queries, run_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
