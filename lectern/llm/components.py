"""Connected components of a table of links, by alternating large and small stars.

Both steps are a minimum for each node, summed up before the shuffle, and a join, which Spark can split when a node has
very many links. Each round is stored in the shared folder. Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import persisted


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Large: larger neighbours go to the least of all. Small: the rest and the node itself do."""
    if large:
        ways = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    else:
        ways = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = ways.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long); root is the least node of its component."""
    now = persisted(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        now = persisted(_star(_star(now, True), False), "links")
        state = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
