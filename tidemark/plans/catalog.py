"""The registry of queries: name -> callable, and name -> the same query in DuckDB's SQL."""

from __future__ import annotations

from tidemark.plans import aggregates, composites, joins, lake, models, ranking, scalars, scans, support, windows  # noqa: F401  they register their queries

QUERIES, ORACLE = lake.QUERIES, lake.ORACLE
FLAGSHIP = "Q8_annual_panel"
