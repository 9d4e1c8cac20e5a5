"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _larger_first(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; a component is its smallest node.

    Large-star and small-star steps in turn, each a minimum per node (combined before the shuffle) and
    a join, until the links are stars: a number of rounds that grows with the logarithm of the longest
    path. Every round is written to the shared folder; the driver sees counts alone. Null nodes and
    loops are left out; no links give no rows.
    """
    now = stored(_larger_first(links.select("a", "b").dropna()), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = tuple(mark)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _larger_first(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least, "a").select("a", F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(_larger_first(small), "links")
