"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from laudario.plans import assembly_queries, io_queries, measure_queries, page_queries, problems, projection_queries, sanitize_queries, semantic_queries, text_queries

MODULES = [problems, text_queries, assembly_queries, measure_queries, sanitize_queries, semantic_queries, page_queries, projection_queries, io_queries]


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
