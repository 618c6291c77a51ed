"""All queries of the core, by name."""

from __future__ import annotations

from millrace.plans import canonical_queries, job_queries, knowledge_queries, page_queries, reference_queries, search_queries, stream_queries, text_queries

FLAGSHIP = "p5_found"
_MODULES = (reference_queries, knowledge_queries, page_queries, search_queries, canonical_queries, job_queries, text_queries, stream_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
