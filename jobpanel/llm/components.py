"""Connected components of an edge list by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_round


def _least(edges: DataFrame) -> DataFrame:
    """Every node with the least of itself and its neighbours, from partial minima."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node leads to one root, and no root leads on."""
    nodes = edges.select(F.col("a").alias("n"), "b", F.lit(0).alias("root")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(None).cast(edges.schema["b"].dataType).alias("b"), F.lit(1).alias("root")))
    seen = nodes.groupBy("n").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("root").alias("root"))
    return seen.filter("low <> high or (low is not null and root = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node`, `root`: every node of the edges (`a`, `b`) with the least node it is connected to.

    Rounds hang larger neighbours, then smaller ones, to the least neighbour, until
    the edges form stars; there are about as many rounds as the logarithm of the
    nodes. A node's neighbours are met as partial minima and join rows, never as a
    group. Self-loops and repeated edges are harmless; nodes are not null.
    """
    tidy = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpoint_round(tidy)
    for _ in range(rounds):
        if _settled(now):
            break
        low = _least(now)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = checkpoint_round(large.filter("a <> b"))  # every edge now leads to a smaller node
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = low.select("a", F.col("low").alias("b"))
        now = checkpoint_round(small.unionByName(own).distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
