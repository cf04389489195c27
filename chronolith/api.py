"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import audit_queries, content_queries, control_queries, functions_queries, history_queries, integrity_queries, lookup_queries, rules_queries, storage_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
