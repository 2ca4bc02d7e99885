"""Every query by name, with its DuckDB equivalent."""

from __future__ import annotations

from . import plans
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "A04_bm25"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "plans"]
