"""All named queries of the library over the fixed tables, and the SQL that checks them."""

from __future__ import annotations

from . import queries_grid, queries_mesh  # noqa: F401  registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
