"""Every registered query with its oracle SQL."""

from __future__ import annotations

from folioscope.plans import line_queries, report_queries, text_queries

QUERIES = text_queries.QUERIES | line_queries.QUERIES | report_queries.QUERIES
ORACLE = text_queries.ORACLE | line_queries.ORACLE | report_queries.ORACLE
