"""All registered queries."""

from __future__ import annotations

from docquorum.plans import annotation, discovery, graph, state  # noqa: F401  (they register)
from docquorum.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
