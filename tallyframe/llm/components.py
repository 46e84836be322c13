"""Connected components of a link table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs(v, u) with m, the least of v and its u's. The minimum is taken before the join, so a hub is no hot group."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
    return pairs.join(least, F.col("v") == F.col("w")).drop("w")


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """links(a, b), longs; the result: node, component (the least node reachable), for every node with a link.

    Null ends and links to oneself are ignored; repeated links count once; no links give an empty table. The number of
    rounds grows with the logarithm of the longest path; an error is raised if ``rounds`` of them do not suffice.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("bigint").alias("v"), F.least("a", "b").cast("bigint").alias("u")).distinct()
    edges, before = materialise(edges, "links"), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _with_least(both).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        small = _with_least(large.distinct())
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = materialise(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
