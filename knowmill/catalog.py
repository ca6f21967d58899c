"""All registered queries of the library's own operators with their SQL."""

from __future__ import annotations

from knowmill.plans import (  # noqa: F401  registers
    answer_queries,
    audit_queries,
    chunk_queries,
    discovery_queries,
    fact_queries,
    graph_queries,
    lexical_queries,
    network_queries,
    page_queries,
    resolution_queries,
    store_queries,
    text_queries,
)
from knowmill.plans.registry import ORACLE, QUERIES

FLAGSHIP = "hybrid_retrieval"
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
