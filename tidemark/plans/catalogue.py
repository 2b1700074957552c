"""All registered queries of the library with their SQL."""

from __future__ import annotations

from . import audit_queries, history_queries, series_queries, table_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES
from .table_queries import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
