"""Connected components of a table of links, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node in ``edges(a long, b long)``.

    Each round points every neighbour at the smallest neighbour of a node; the links become stars around the smallest node after a number of rounds that grows with
    the logarithm of the longest path. Each round is written to the shared folder, and only counts reach the driver. A star's links are dealt over several tasks.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(both(edges.filter("a <> b")).filter("a > b").distinct())
    for _ in range(max_rounds):
        # large star: link each larger neighbour of u to the smallest of u and its neighbours
        each = both(now)
        least = each.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = salted_join(each, least.drop("n"), "a", counts=least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: link u and its smaller neighbours to the smallest of them
        large = stored(large.filter("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low.drop("n"), "a", counts=low)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(small.filter("a > b").distinct())
        discard(large)
        # equal sets of links: a fixed point, where every link ends in a node that has no smaller neighbour
        totals = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = tuple(totals(now)) == tuple(totals(after))
        discard(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    ends = now.groupBy("a").agg(F.min("b").alias("component"))
    return ends.select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
