"""Connected components of an edge table, with this subpackage's written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmesh.operators import graph

from .common import kept


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node that an edge (u, v: long, not null) has. Self-loops name nodes
    without links; repeated edges change nothing."""
    return graph.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), write=lambda df: kept(df, "edges"))
