"""All queries of the geometry engine and their SQL."""

from __future__ import annotations

from . import kernel_queries, source_queries  # noqa: F401  they register their queries
from .catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
