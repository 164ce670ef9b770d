"""Connected components of an edge table by alternating large and small stars.

Each step takes, for every node, the minimum of its neighbours (a partial
aggregate) and turns the edges towards it.  The minima are written to the
shared folder before they are joined back: both sides of the join are then
plain shuffles (or the minima are broadcast, if they are small), so that Spark
can split a hub with very many edges.  Edges are written at each round, and the
tables of the round before are deleted.  The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    turned = both.where("b > a").join(broadcast_if_small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = materialize(turned.distinct(), "edges")
    discard(least, edges)
    return out


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(broadcast_if_small(least), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    out = materialize(moved.where("a <> b").distinct(), "edges")
    discard(least, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node it reaches) of every node that has an edge to another; a written table.

    edges: a, b (long); self-loops, repeated edges and edges with a null end
    are allowed and say nothing.  Without edges there are no rows.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        none = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        none.scratch_path = edges.scratch_path
        return none
    last = None
    while True:
        edges = _small(_large(edges))
        # A fixed point keeps the same set of edges: compare its size and two sums of hashes.
        sums = [F.sum(F.xxhash64("a", "b", F.lit(s)).cast("decimal(38,0)")) for s in (1, 2)]
        now = tuple(edges.agg(F.count(F.lit(1)), *sums).first())
        if now == last:
            break
        last = now
    stars = edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
    out = materialize(stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct()), "components")
    discard(edges)
    return out
