"""All queries and their SQL."""

from __future__ import annotations

from roadlark.plans import events, inspections, roads, tracks  # noqa: F401  they register their queries
from roadlark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
