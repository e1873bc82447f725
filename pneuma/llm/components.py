"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import removed, written


#: A node with more than 1 / HUB_SHARE of all edge ends, and HUB_EDGES edges at least, is a hub; at most HUB_SHARE nodes are.
HUB_SHARE, HUB_EDGES = 1000, 4096


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """edges with the m of their a. Edges of hubs (nodes of more edges than `hub`; None: there are none) stay where they are
    and meet broadcast rows, so no task gets one node's."""
    if hub is None:
        return edges.join(least.select("a", "m"), "a")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("a", "m"))  # at most HUB_SHARE rows
    marked = edges.join(hubs, "a", "left")
    rest = marked.where("m is null").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
    return marked.where("m is not null").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge (columns a, b).

    Every round is a grouped minimum and a join on nodes; edges are written
    between rounds, and their number never grows. Rounds end when each edge
    leads to a node that has no smaller neighbour, and is its node's only one.
    Nodes of very many edges are summed before they are shuffled, and their
    minimum is broadcast.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    while True:
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"))
        count, most, open_ = nodes.agg(F.sum("n"), F.max("n"), F.count_if(F.expr("up > 1 or up = 1 and n > 1"))).first()
        if not open_:
            break
        # No node gets more edges by a star than it has.
        hub = max(HUB_EDGES, count // HUB_SHARE)
        hub = hub if most > hub else None
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both, least, hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least, hub).where("b <> m").select(F.col("m").alias("b"), F.col("b").alias("a"))
        old, pairs = pairs, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        removed(old)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
