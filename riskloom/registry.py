"""Queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from riskloom.plans import comparisons, episodes, long, monitoring, series

_PARTS = (series, long, episodes, monitoring, comparisons)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
