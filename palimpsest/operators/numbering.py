"""Row numbers, batches and neighbours without a one-task sort.

A window over a whole table, or over a key that holds a third of it, runs in one task. Two exact
ways around that are used here:

* ``number_rows``: range partitions in the wanted order, checkpointed, plus one offset per
  partition. The only table that meets in one task has one row per partition.
* ``next_in_sequence``: for integer positions, windows over (key, position div width), and a
  second window over one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.skew import salted_lookup
from palimpsest.workspace import durable

CHUNK = 4096
_ROW_BITS = 33   # monotonically_increasing_id keeps the row number within a partition in 33 bits


def chunk_of(position: str | Column, width: int = CHUNK) -> Column:
    """Number of the run of ``width`` positions (whole numbers from 0) that a position falls in."""
    at = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", at, F.lit(width))


def number_rows(df: DataFrame, order: list[str], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Global position 0, 1, 2, … in the given order, which must tell all rows apart.

    The sorted partitions are checkpointed, because a range boundary that is sampled twice could
    fall elsewhere the second time, and a lost executor must not renumber the rows.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    own_id = F.monotonically_increasing_id()
    tagged = ranged.select(
        "*", F.spark_partition_id().alias("_part"),
        own_id.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_at"))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")
    offsets = sizes.select("_part", before.alias("_before"))
    # one row per range partition, at most ``parts``: a proven bound for the broadcast
    return (tagged.join(F.broadcast(offsets), "_part")
            .select(*df.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name)))


def row_ids(df: DataFrame, keys: list[str], order: list[str], name: str = "row_id",
            within: str = "pos", partitions: int | None = None) -> DataFrame:
    """Position in the whole table and position within each key, both from 0."""
    numbered = number_rows(df, [*keys, *order], name, partitions)
    starts = numbered.groupBy(*keys).agg(F.min(name).alias("_first"))
    return (salted_lookup(numbered, starts, keys, [name])
            .select(*df.columns, name, (F.col(name) - F.col("_first")).alias(within)))


def _total(df: DataFrame) -> Column:
    return df.select(F.count("*")).scalar()


def split_batches(df: DataFrame, order: list[str], size: int, name: str = "batch") -> DataFrame:
    """ceil(n / size) batches in order, sizes at most one apart, the larger ones first."""
    numbered = number_rows(df, order, "_row")
    total = _total(numbered)
    batches = F.ceil(total / F.lit(size)).cast("long")
    sized = numbered.select("*", F.floor(total / batches).cast("long").alias("_each"),
                            (total % batches).alias("_larger"))
    edge = F.col("_larger") * (F.col("_each") + 1)
    batch = F.when(F.col("_row") < edge, F.floor(F.col("_row") / (F.col("_each") + 1))).otherwise(
        F.col("_larger") + F.floor((F.col("_row") - edge) / F.col("_each")))
    return sized.select(*df.columns, batch.cast("long").alias(name))


def head_fraction(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """The first int(n * fraction) rows in the given order."""
    numbered = number_rows(df, order, "_row")
    keep = F.floor(_total(numbered) * F.lit(fraction))
    return numbered.where(F.col("_row") < keep).drop("_row")


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int, name: str = "shuffle_pos") -> DataFrame:
    """Rows in an order that depends on key and seed alone, not on the partitions."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return number_rows(df.withColumn("_mixed", mixed), ["_mixed", *keys], name).drop("_mixed")


def next_in_sequence(df: DataFrame, keys: list[str], position: str, values: list[str],
                     prefix: str = "next_", width: int = CHUNK) -> DataFrame:
    """Values of the following row of the same key, null after the last one.

    ``position`` is a whole number, not negative, and may have gaps. A key of any length is cut
    into chunks of ``width`` positions; the last row of a chunk takes its values from the first row
    of the next chunk that has rows. Those first rows are looked for at positions from ``width`` on
    alone, a filter that reaches the scan, so shorter keys add nothing but the local window.
    """
    chunked = df.withColumn("_chunk", chunk_of(position, width))
    local = W.partitionBy(*keys, "_chunk").orderBy(position)
    packed = F.struct(*values)
    rows = chunked.withColumn("_next", F.lead(packed).over(local))
    heads = (df.where(F.col(position) >= width).withColumn("_at", chunk_of(position, width))
             .groupBy(*keys, "_at").agg(F.min_by(packed, position).alias("_head")))
    across = W.partitionBy(*keys).orderBy("_at")
    before = F.coalesce(F.lag("_at").over(across), F.lit(0))
    follow = heads.select(*keys, before.alias("_chunk"), "_head")
    found = F.coalesce(F.col("_next"), F.col("_head"))
    return (rows.join(follow, [*keys, "_chunk"], "left")
            .select(*df.columns, *[found[v].alias(f"{prefix}{v}") for v in values]))
