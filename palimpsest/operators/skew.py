"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT, SAMPLE, LEAST = 1000, 64, 16   # keys that are copied at most; one row in so many is counted; a key with fewer counted rows is not hot


def default_salts(df: DataFrame) -> int:
    """A power of two near one salt per eight shuffle partitions, 2 to 64: a key that holds a third
    of the rows of a job with 2,000 partitions is split into 64 tasks, while a small job copies its
    lookup twice."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
    return 1 << max(1, min(6, wanted.bit_length() - 1))


def hot_keys(rows: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """The keys with most rows, at most HOT of them: every other key has less than 1 / HOT of the rows.

    Counted on one row in SAMPLE, by a hash of ``spread_by``, so that any run finds the same ones. They decide where rows are worked on, never
    what comes out: a key that is missed is joined in one task, one too many is copied to some more.
    """
    some = rows.where(F.shiftrightunsigned(F.xxhash64(*spread_by), 32).bitwiseAND(F.lit(SAMPLE - 1)) == 0)
    counts = some.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])).groupBy(*on).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") >= LEAST).orderBy(F.desc("_n"), *on).limit(HOT).select(*on)


def salted_copies(lookup: DataFrame, hot: DataFrame, on: list[str], salts: int) -> DataFrame:
    """The lookup rows of hot keys once a salt, all others once."""
    last = F.coalesce("_last", F.lit(0).cast("long"))
    marked = lookup.join(_marked(hot, salts), on, "left")
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_last")


def _marked(hot: DataFrame, salts: int) -> DataFrame:
    return F.broadcast(hot.withColumn("_last", F.lit(salts - 1).cast("long")))   # at most HOT rows


def by_shuffle(table: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: planners size a stored table by its compressed file, and a vocabulary of some
    megabytes there is a hundred in the driver."""
    return table.hint("merge")


def salted_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], spread_by: list[str],
                  how: str = "inner", salts: int | None = None, like: DataFrame | None = None, large: bool = False) -> DataFrame:
    """Join ``rows`` to a table with one row per key.

    The rows of a hot key are spread over ``salts`` tasks by a hash of ``spread_by`` (columns that tell
    the rows of one key apart), and its lookup row is sent to all of them. The hash is of the row
    itself, so a task that is run again gives the same rows. Other keys are joined as they are: copies of a whole
    vocabulary would be shuffled, or broadcast, as planners judge a table by its size before the copies. There is no broadcast hint:
    AQE turns the join into a broadcast one only if the measured lookup side is small. (AQE's own skew-join
    splitting does not apply here, because the lookup side comes straight out of an aggregate.)
    ``like`` has the keys as often as ``rows`` and is cheaper to read, to find the hot ones in. ``large``: the lookup grows with the texts, see by_shuffle().
    """
    salts = salts or default_salts(rows)
    hot = hot_keys(rows if like is None else like, on, spread_by)
    # a mask and not a remainder: it is never null, so no null filter is pushed to one side only and
    # two uses of the same table can share one exchange
    salt = F.xxhash64(*spread_by).bitwiseAND(F.coalesce("_last", F.lit(0).cast("long")))
    salted = rows.join(_marked(hot, salts), on, "left").withColumn("_salt", salt).drop("_last")
    copies = salted_copies(lookup, hot, on, salts)
    return salted.join(by_shuffle(copies) if large else copies, [*on, "_salt"], how).drop("_salt")
