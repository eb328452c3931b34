"""Every registered query with its SQL."""

from __future__ import annotations

from graphlake.plans import data_queries, feature_queries, graph_queries, ml_queries

FLAGSHIP = "bfs_levels"

QUERIES = {**graph_queries.QUERIES, **feature_queries.QUERIES, **ml_queries.QUERIES, **data_queries.QUERIES}
ORACLES = {**graph_queries.ORACLES, **feature_queries.ORACLES, **ml_queries.ORACLES, **data_queries.ORACLES}
