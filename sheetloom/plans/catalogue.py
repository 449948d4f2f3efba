"""All registered queries."""

from __future__ import annotations

from . import cell_queries, editing_queries, evaluation_queries, export_queries, function_queries, join_queries, kpi_queries, linkage_queries, listing_queries, ordered_queries, quality_queries, registry_queries, source_queries, work_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
