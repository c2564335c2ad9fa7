"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that links reach, for each node with a link.

    links has columns a and b of one orderable type. Rounds of large-star and
    small-star steps bend links towards smaller nodes until all are stars; the
    number of rounds grows with the logarithm of the longest chain. Each round
    is a written table in the shared folder, and only two numbers of it reach
    the driver. A node of very many links is counted map-side and joined, so
    Spark can split its rows over tasks.
    """
    edges = stage(_downwards(links), "links")
    seen = _state(edges)
    while seen[0]:
        bent = stage(_small_star(_large_star(edges)), "links")
        unstage(edges)
        edges = bent
        if (now := _state(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _downwards(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node a to the smaller b."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Tells one set of links from another."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a node link to the smallest in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return _downwards(edges.join(least, edges["b"] == least["node"]).select("a", F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    moved = edges.join(least, edges["a"] == least["node"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downwards(moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))
