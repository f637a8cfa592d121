"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def registered(name: str, *, needs: tuple[str, ...] = (), sql: str | None = None):
    """Register a query. `needs` lists the shared views its SQL reads, in any order."""
    from docquorum.plans.views import with_views

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql, needs)
        return fn

    return add
