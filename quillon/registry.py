"""Queries by name, the SQL that must give the same rows, and the flagship."""

from __future__ import annotations

from .plans import curated_queries, data_queries, evidence_queries, import_queries, lookup_queries, match_queries, page_queries, record_queries, rule_queries, run_queries, search_queries, table_queries  # noqa: F401  registers
from .plans.tables import QUERIES, SQL

FLAGSHIP = "match_status_rank"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
