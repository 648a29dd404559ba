"""The engine's own queries, by name, and their SQL."""

from __future__ import annotations

from .plans import flows, kernels, models, patterns, series

QUERIES = {**series.QUERIES, **patterns.QUERIES, **models.QUERIES, **kernels.QUERIES, **flows.QUERIES}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
