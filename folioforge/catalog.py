"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from folioforge.plans import common, graph_plans, job_plans, table_plans, text_plans, write_plans  # noqa: F401  # the plans register themselves

FLAGSHIP = text_plans.FLAGSHIP


def queries() -> dict[str, common.Query]:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.SQL)
