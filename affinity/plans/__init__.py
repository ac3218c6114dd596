"""Named queries over the standard tables, with the SQL that checks them.

Orders stand for tracks, suppliers for artists, part types for genres, brands
for producers, quantities for seconds, events for a listening history.
"""

from __future__ import annotations

from affinity.plans import entity_queries, graph_queries, model_queries, report_queries, source_queries, taste_queries, time_queries, track_queries
from affinity.plans.registry import Query

PARTS = [graph_queries, track_queries, entity_queries, time_queries, model_queries, report_queries, source_queries, taste_queries]


def queries() -> dict[str, Query]:
    """Every query of this package by name."""
    return {name: q for part in PARTS for name, q in part.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    """The DuckDB SQL of each query that SQL can express."""
    return {name: sql for part in PARTS for name, sql in part.REGISTRY.sql.items()}
