"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import durable


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, least): each edge from both ends, with the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("of"), F.least("u", "least").alias("least"))
    return both.join(least, both.u == least.of).drop("of")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the links (u, v); the component is its least id.

    Large star: all greater neighbours of a node move to its least neighbour. Small star: a node and its smaller
    neighbours do. Both keep what is connected; edges end as stars around the least ids. A node's edges are
    grouped by partial minima and joined, so the join of a node with very many is split at run time."""
    edges = durable(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        large = _least_neighbour(edges).where("v > u").select(F.col("least").alias("u"), "v").where("u <> v").distinct()
        # small star: from each greater end, to its smaller neighbours
        smaller = large.select(F.col("v").alias("top"), F.col("u").alias("low"))
        least = smaller.groupBy("top").agg(F.min("low").alias("least")).withColumnRenamed("top", "of")
        small = smaller.join(least, smaller.top == least.of)
        moved = small.select(F.col("least").alias("u"), F.col("low").alias("v")).unionByName(small.select(F.col("least").alias("u"), F.col("top").alias("v")))
        after = durable(moved.where("u <> v").distinct())
        # done when every v hangs on one u that hangs on nothing
        many = after.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if many.isEmpty() and after.join(after.select(F.col("v").alias("w")), F.col("u") == F.col("w"), "left_semi").isEmpty():
            edges = after
            break
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
