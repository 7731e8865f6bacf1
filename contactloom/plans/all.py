"""Every query module, imported for what it registers."""

from __future__ import annotations

from . import contact_queries, map_queries, source_queries
from .registry import QUERIES, SQL

MODULES = (contact_queries, map_queries, source_queries)
__all__ = ["MODULES", "QUERIES", "SQL"]
