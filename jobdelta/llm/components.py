"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to smaller neighbours until every component is a star around its smallest
node. All of it is grouping with partial minima and joins; each round is written, so a lost executor costs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node that a row (a, b) of `links` names."""
    stars = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    nodes = None
    state = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        stars = written(small.distinct(), "stars")
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
