"""The registered queries and their SQL."""

from __future__ import annotations

from harrow.plans import queries_blocks, queries_core, queries_extra, queries_models, queries_more, queries_panels, queries_reports, queries_sources, queries_stages  # noqa: F401  they register themselves
from harrow.plans.declare import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
