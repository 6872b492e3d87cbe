"""All registered queries and their SQL."""

from __future__ import annotations

from plotweave.plans import aggregate_queries, cell_queries, export_queries, feature_queries, join_queries, more_queries, record_queries, scalar_queries  # noqa: F401
from plotweave.plans.registry import ORACLES, QUERIES

FLAGSHIP = "f_usage_periods"


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
