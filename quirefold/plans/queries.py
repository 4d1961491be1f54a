"""Registered queries of the library's own operators, with their DuckDB twins."""

from __future__ import annotations

from quirefold.plans import aggregate_queries, event_queries, join_queries, payload_queries, projection_queries, window_queries  # noqa: F401
from quirefold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
