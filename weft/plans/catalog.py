"""Registered queries of the package's own operators, with their DuckDB oracles."""

from __future__ import annotations

from weft.plans import code_queries, fact_queries, file_queries, page_queries, report_file_queries, report_queries, rows_queries, source_queries, summary_queries, text_queries
from weft.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code_queries", "fact_queries", "file_queries", "page_queries", "report_file_queries", "report_queries", "rows_queries", "source_queries", "summary_queries", "text_queries"]
