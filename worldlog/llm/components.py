"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b: long) can reach, itself included.

    Every round is a grouping and a join, written to the shared folder; the count of edges that still
    change is all that the driver sees. Empty edges give an empty table; repeats and loops do no harm.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    while True:
        after = written(_small_star(_large_star(now)), "edges")
        heads = after.select(F.col("b").alias("a")).distinct()
        # a forest of stars: no head has an edge of its own, and no node has two heads
        torn = after.groupBy("a").count().filter("count > 1").select("a")
        if after.join(heads, "a", "left_semi").select("a").union(torn).limit(1).count() == 0:
            break
        now = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads.select("a", "a"))
