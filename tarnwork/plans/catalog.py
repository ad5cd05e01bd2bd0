"""All queries of the library, and their SQL oracles."""

from __future__ import annotations

from tarnwork.plans import code_queries, context_queries, graph_queries, log_queries, memory_queries, more_queries, retrieval_queries, review_queries, source_queries, stream_queries  # noqa: F401
from tarnwork.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
