"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a and b, two numbers), root the smallest node reachable.

    A large-star step ties every larger neighbour of a node to the smallest node of its neighbourhood, a small-star
    step does so with the smaller ones; both keep what is connected. They end when nothing changes, with one star for
    each component. Each step is an aggregate with a partial aggregate before its shuffle and an equi-join, so a node
    with very many neighbours is never gathered in one place but for the rows of a join, which Spark may split. The
    lineage is cut after every round.
    """
    a, b = F.col("a"), F.col("b")
    edges = common.checkpoint(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(a.alias("node"), b.alias("root")).union(edges.select(b, b)).distinct()
        seen = state
        both = edges.union(edges.select(b, a))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = common.checkpoint(small.union(least).distinct())
