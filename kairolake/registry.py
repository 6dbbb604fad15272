"""All registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def _modules() -> list:
    from .plans import queries_heads, queries_jobs, queries_plans, queries_reports, queries_series, queries_sources, queries_stats, queries_text

    return [queries_series, queries_plans, queries_stats, queries_text, queries_sources, queries_jobs, queries_heads, queries_reports]


def queries() -> dict[str, Callable]:
    return {name: run for module in _modules() for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, (_, sql) in module.QUERIES.items() if sql}
