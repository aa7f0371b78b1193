"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is an aggregate and a join over the links, so a node with any number of links is never
held by one task; the links of a step are written to the shared folder and the step before is
deleted. Labels are the smallest id of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import drop_staged, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them. Links point from large to small."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    below = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a and b, longs)."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == seen or not n:
            break
        seen = (n, total)
        after = stage(_small_star(_large_star(now)), "links")
        drop_staged(now)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
