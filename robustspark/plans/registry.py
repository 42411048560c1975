"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from robustspark.plans import audit, cells, evidence, portfolios, stored, tables, worlds

PLANS = (tables, cells, portfolios, worlds, audit, evidence, stored)


def queries() -> dict:
    """Name to callable of (spark, sf_dir)."""
    return {k: v for plan in PLANS for k, v in plan.QUERIES.items()}


def oracles() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: v for plan in PLANS for k, v in plan.ORACLES.items()}
