"""Connected components of a table of links, by alternating star steps; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node links its larger (large) or its smaller-or-equal neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lows = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(lows, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lows.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of edges (a, b), both long and not null; loops and repeats are allowed.

    Rounds go on until one changes nothing; their number grows with the logarithm of the nodes. Each is written to the
    shared folder. A node of very many links is never gathered: minima are combined
    before the shuffle, and the join back is one that Spark can split.
    """
    now = materialise(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        now = materialise(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
