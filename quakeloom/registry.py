"""All registered queries of the seismic library and the SQL that checks them."""

from __future__ import annotations

from .plans import analysis_queries, catalog_queries, cluster_queries, database_queries, function_queries, plane_queries

MODULES = (database_queries, function_queries, catalog_queries, plane_queries, cluster_queries, analysis_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = plane_queries.flagship
