"""All queries of the core and their SQL."""

from __future__ import annotations

from kernwerk import queries_data, queries_eval, queries_facts, queries_link, queries_plan, queries_retrieval, queries_select, queries_text

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (queries_data, queries_text, queries_retrieval, queries_facts, queries_eval, queries_plan, queries_select, queries_link):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
FLAGSHIP = "hybrid_search"
