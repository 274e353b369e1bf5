"""All queries of the library and their DuckDB SQL, by name."""

from __future__ import annotations

from cairnspark.plans import graph_queries, resolution_queries

QUERIES = graph_queries.QUERIES | resolution_queries.QUERIES
ORACLE_SQL = graph_queries.ORACLE_SQL | resolution_queries.ORACLE_SQL
