"""Every relational query of the engine by name, with the SQL it must agree with."""

from __future__ import annotations

from stowage.plans import content_queries, delta_queries, layout_queries, member_queries, olap_queries, store_queries, telemetry_queries  # noqa: F401  they register themselves
from stowage.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
