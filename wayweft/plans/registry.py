"""Name -> query and name -> DuckDB oracle for the engine's own operators."""

from __future__ import annotations

from . import extract_queries  # noqa: F401  registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
