"""Connected components by alternating large and small stars (Kiveris and others, 2014).

A round replaces edges by edges to smaller nodes until every component is a star around its
smallest node. Minima fold in the map tasks and hot nodes are split by the join, so no node's
neighbours are ever gathered. Each round is stored in the shared folder, which cuts the lineage.
"""

from pyspark.sql import functions as F

from txrisk.session import written


def _ends(edges):
    """Each edge once, the larger node first; loops are left out."""
    return edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.where(F.col("v") > F.col("u")).join(least, "u")
    # One row for each edge, so repeated ones may stay until the small star makes them distinct.
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges):
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ends(linked.unionByName(least.select("u", F.col("m").alias("v"))))


def _are_stars(edges):
    """Whether every node has one smaller neighbour or is one, not both: no round would change that."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    )
    nodes = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return nodes.where(F.col("smaller") + F.col("larger") > 1).isEmpty()


def components(edges):
    """(node, root) for every node of ``edges`` (u, v) that isn't its component's smallest.

    No edges give no rows. Repeated edges, both directions of one edge, and loops change nothing.
    """
    state = written(_ends(edges), "component-edges")
    while not _are_stars(state):
        state = written(_small_star(_large_star(state)), "component-edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
