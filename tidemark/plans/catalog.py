"""All registered queries of the market part."""

from __future__ import annotations

from tidemark.plans import archive_queries, diagnostic_queries, feature_queries, market_queries, model_queries, screening_queries, study_queries

_MODULES = (market_queries, feature_queries, study_queries, model_queries, diagnostic_queries, screening_queries, archive_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
