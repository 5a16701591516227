"""All queries of the core and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import graph
from knotwork.plans import answer_queries, batch_queries, graph_queries  # noqa: F401  (they register their queries)
from knotwork.plans.base import QUERIES, SQL, Query
from knotwork.sources.tables import table


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Records merged into a graph, and its ten most central nodes with their type, weight and degree."""
    nodes, edges = graph.build_round(None, *(table(spark, folder, t) for t in ("entities", "hyperedges", "edges")))
    top = graph.top_central(nodes, edges, 10)
    return top.join(nodes, "id").select("id", "role", "entity_type", F.round("weight", 4).alias("weight"), "degree", F.round("centrality", 9).alias("centrality"))
