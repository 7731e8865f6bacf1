"""Connected components by star contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


# The smallest neighbours are written before they are joined: a join of two tables can split a node
# that very many edges have, one on top of an aggregate can't.


def _large_star(space: Workspace, edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = space.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-least")
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b")


def _small_star(space: Workspace, edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are all linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = space.write(down.groupBy("a").agg(F.min("b").alias("m")), "small-least")
    return down.join(least, "a").select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))


def components(space: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Each round writes its edges to the shared folder, and ends when a round changes none.  The
    rounds needed grow with the logarithm of the nodes, so ``rounds`` is a guard and no limit.
    """
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = space.write(now, "star-0")
    told = _told(now)
    for k in range(1, rounds):
        large = space.write(_large_star(space, now).filter("a <> b").distinct(), "large")
        now = space.write(_small_star(space, large).filter("a <> b").distinct(), f"star-{k}")
        if k > 1:
            space.drop(f"star-{k - 2}")
        before, told = told, _told(now)
        if told == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
    raise RuntimeError("star contraction didn't end")


def _told(edges: DataFrame) -> tuple:
    """The edges' number and checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
