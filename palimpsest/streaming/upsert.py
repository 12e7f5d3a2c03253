"""Upsert arriving result rows, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.operators.results import latest_rows


def current(spark: SparkSession, table: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Latest row per key over all batches."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(table)
    return latest_rows(rows, keys)


def upsert_stream(spark: SparkSession, source: str, schema: T.StructType, table: str, progress: str,
                  keys: list[str], files_per_batch: int = 1) -> None:
    """Each batch is reduced to its latest row per key and written to a folder named by its query and number.

    A batch that is run again replaces its own folder, so the table is the same however often a
    batch is retried. The query's id lives in ``progress``: a stream that starts anew has another id and
    never writes over older batches. Old batches are not rewritten; readers merge with ``current``.
    """

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        latest_rows(batch, keys).write.mode("overwrite").parquet(f"{table}/{query}-{number}")

    run = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
           .writeStream.foreachBatch(write).option("checkpointLocation", progress)
           .trigger(availableNow=True).start())
    run.awaitTermination()
