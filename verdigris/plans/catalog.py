"""All registered queries and their SQL."""

from __future__ import annotations

from verdigris.plans import corpus_queries, graph_queries, memory_queries, profile_queries, retrieval_queries, stream_queries, style_queries, text_queries  # noqa: F401
from verdigris.plans.registry import QUERIES, SQL, Query

FLAGSHIP: Query = retrieval_queries.hybrid_rrf


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
