"""Means of vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, keys: list[str], vector: str, mask: str | None = None, name: str = "mean") -> DataFrame:
    """Mean vector per key, over the rows whose mask is not 0.

    Sums per (key, place) are combined before the shuffle, so a key of any size sends one row per
    place and task; the array gathered at the end has one entry per place.
    """
    rows = df if mask is None else df.where(F.col(mask) != 0)
    means = (rows.select(*keys, F.posexplode(vector).alias("_at", "_x"))
             .groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_mean")))
    gathered = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_mean"))).alias("_all"))
    return gathered.select(*keys, F.transform("_all", lambda s: s["_mean"]).alias(name))
