"""Connected components of a graph that no single machine holds.

Alternating stars: each round first links every node's larger neighbours to its smallest one,
then every node and its smaller neighbours to the smallest. Paths shrink by halves, stars stay
stars, and the rounds end when every edge points from a node to its component's smallest node.
All steps are joins and aggregations that combine before they shuffle, so a hub with a third of
all edges sends one row a task; the join back to a hub's edges is one Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.session import materialize


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself: ``node, least``."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    return edges.select(ends).groupBy("node").agg(F.min("other").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges).select(F.col("node").alias("b"), F.least("node", "least").alias("least"))
    return edges.join(least, "b").select("a", F.col("least").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    linked = edges.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable nodes -> ``node, component`` for every node of an edge.

    The component is its smallest node. Loops, repeated and reversed edges change nothing;
    rows with a null end are no edges; no edges give no rows. Nodes that only occur in loops
    are left out, as they are alone.
    """
    spark = edges.sparkSession
    ordered = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ordered, state = materialize(ordered, "edges", spark), None
    while True:
        now = ordered.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        ordered = materialize(_small_star(_large_star(ordered)), "edges", spark)
    roots = ordered.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ordered.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
