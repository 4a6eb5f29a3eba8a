"""Connected components of a graph given by its links, by alternating large and small stars.

Each step ties all larger neighbours of a node to the smallest neighbour (large star), or all smaller ones and the node
itself (small star); after a number of steps logarithmic in practice every component is one star around its smallest node.
Links never leave the executors. The steps' results are written to the shared folder.

Repeated links, links in both directions and loops are allowed; links with a null end are ignored. Without links the
result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def _mins(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its partners; partial minima before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _tied(pairs: DataFrame, mins: DataFrame) -> DataFrame:
    """(v, m) of all pairs. mins is a table, so both sides are dealt out for this join, and a node with very many
    partners can be split between tasks."""
    return pairs.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _settled(links: DataFrame) -> bool:
    """Whether the links (u larger, v smaller) are stars already: no node is both an end and a centre, or has two centres."""
    ends = links.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    if ends.where("lo <> hi").head(1):
        return False
    return not links.select("v").distinct().join(ends.select(F.col("u").alias("v")), "v", "left_semi").head(1)


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): each node that has a link, with its component's smallest node. Every round ties some node to a
    smaller one until none is left, so it ends."""
    plain = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").select("u", "v").distinct()
    current = written(plain, "links")
    while not _settled(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = written(_mins(both), "mins")
        large = written(_tied(both.where("v > u"), mins).where("u <> v").distinct(), "links")  # u > v
        low = written(_mins(large), "mins")
        small = _tied(large, low).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        new = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        forget(links.sparkSession, current, mins, large, low)
        current = new
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
