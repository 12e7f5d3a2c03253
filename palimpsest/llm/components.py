"""Connected components of links between integer ids, by alternating large-star and small-star steps.

Every step replaces links by links to the smallest neighbour seen, and is an aggregation with map-side combine and a join;
a hub is split by the skew join. Each round is a table in the shared folder, so no lineage grows and a lost executor
costs one round. Rounds end when the links no longer change. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.workspace import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every id in (a, b); the component is its smallest id. Loops and repeats are allowed."""
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = _signature(now)
    while last[0]:
        now = stored(_small_star(_large_star(now)), "links")
        this = _signature(now)
        if this == last:
            break
        last = this
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m"))
    moved = links.join(least, F.col("a") == F.col("w")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()
