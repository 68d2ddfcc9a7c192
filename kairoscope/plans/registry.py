"""All registered queries outside the subpackage on training text."""

from __future__ import annotations

from kairoscope.plans import cluster_queries, graph_queries, io_queries, pathway_queries, prep_queries, switch_queries

_MODULES = (switch_queries, prep_queries, cluster_queries, graph_queries, pathway_queries, io_queries)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
