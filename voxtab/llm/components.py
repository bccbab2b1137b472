"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang the neighbours of each node from the least of them.

    ``large`` moves the larger neighbours of a node, otherwise the smaller ones and
    the node itself. The least neighbour is a partial aggregate, so a node of any
    degree reaches it as one row per task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large \
        else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where("b > a") if large else both
    hung = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest member) for every node of an edge.

    edges: two columns ``a`` and ``b`` of one orderable type, in any direction.
    Alternates large-star and small-star steps, each pair of them written out,
    until nothing changes; that takes about the square of the logarithm of the
    longest chain. Every component ends as a star around its smallest node.
    An empty table gives an empty table; self loops and NULL ends are left out.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct())
    seen = _state(now)
    while seen[0]:
        now = written(_star(_star(now, True), False))
        state = _state(now)
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
