"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _least(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: every pair with the least of u's neighbours and u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.withColumn("m", F.least("u", "m")), "u")


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """``node, root`` for every node that has a link; the root is the least node of its component.

    Each round is two grouped minima, combined before the shuffle, and two joins; links of a hub are never gathered.
    The rounds needed grow with the logarithm of the longest path. Raises if they do not suffice.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        star = _least(large)
        small = star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        after = durable(small.where("u != v").distinct(), "links")
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            least = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(least)
    raise RuntimeError("components did not settle")
