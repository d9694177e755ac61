"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps until every node but the roots has one edge, to a
    root. Each step keeps one edge per node pair; a hub's neighbours stay spread, as only the
    minimum is gathered per node. An edge from a node to itself gives a component of one node.
    """
    own = edges.filter("a = b").select(F.col("a").alias("u"), F.col("b").alias("m"))
    links = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct()
    )
    while True:
        both = links.union(links.select(F.col("m").alias("u"), F.col("u").alias("m")))
        least = both.groupBy("u").agg(F.min("m").alias("low"))
        large = (
            both.join(least, "u")
            .filter("m > u")
            .select(F.col("m").alias("u"), F.least("u", "low").alias("m"))
            .distinct()
        )
        large = stored(large)
        least = large.groupBy("u").agg(F.min("m").alias("low"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("low").alias("m")), F.struct(F.col("m").alias("u"), F.col("low").alias("m")))).alias("e"))
            .select("e.*")
            .filter("u <> m")
            .distinct()
        )
        links = stored(small)
        # done when every link ends at a root and no node hangs on two of them
        ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(links.select("m", F.lit(0), F.lit(1)))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or up = 1 and down = 1").isEmpty():
            break
    roots = links.select(F.col("m").alias("u"), "m").union(own).distinct()
    found = links.union(roots).groupBy("u").agg(F.min("m").alias("component"))
    return found.withColumnRenamed("u", "id")
