"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from refloom.llm import queries, sql

QUERIES = queries.QUERIES
ORACLES = sql.ORACLES
