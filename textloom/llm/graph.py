"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge, none of them repeated, hangs a node on a root, and every node on one."""
    upper = edges.select(F.col("u").alias("node"), F.lit(1).alias("hung"), F.lit(0).alias("holds"))
    ends = upper.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("hung"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hung").alias("hung"), F.max("holds").alias("holds"))
    return nodes.agg(F.count_if(F.expr("hung > 1 or hung = 1 and holds = 1"))).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point downwards; the neighbours of a node, and itself, are hung on its least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_edges(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v): every node of an edge but the least of its component, and that least node; stored.

    Large-star and small-star steps alternate until all edges form stars, which takes a number of
    rounds logarithmic in the length of paths; none, if they form stars already. Every round writes its
    edges to the shared folder, so lineage stays short. No node's neighbours are gathered: a step is a
    minimum per node and a join with one row per node on one side, whose hot side adaptive execution can
    split. Loops, repeated edges and edges with a null end are ignored.
    """
    a, b = F.col(left), F.col(right)
    edges = stored(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)))
    return edges


def members(stars: DataFrame) -> DataFrame:
    """(node, component) for every node of ``star_edges``."""
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node."""
    return members(star_edges(edges, left, right))
