"""Connected components of a table of links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.functions.expressions import join_groups
from abundex.llm.common import written


def _to_least(links: DataFrame) -> DataFrame:
    """Every (u, v) with the least node among u and its partners as ``m``."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return join_groups(links, least.select("u", F.least("u", "m").alias("m")), ["u"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): the least node reachable from it.

    A large star ties the larger partners of a node to its least partner, a small star ties the
    smaller ones; both keep components as they are and the links end as stars around the roots.
    The number of rounds grows with the logarithm of the longest chain. Each round is a table in
    the shared folder, and a star of any size is handled by sums and joins that Spark can split.
    """
    links = written(links.select("u", "v").filter("u != v").distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
        starred = _to_least(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            starred.select("u", F.col("m").alias("v"))
        )
        links = written(small.filter("u != v").distinct(), "links")
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
