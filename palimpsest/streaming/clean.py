"""Clean raw generations as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.answers import clean_generated
from palimpsest.functions.text import has_min_words


def cleaned(raw: DataFrame, least_words: int = 3) -> DataFrame:
    """The batch cleaning step; the stream runs the same expressions."""
    filled = raw.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    return clean_generated(filled, "raw_text").drop("raw_text").where(has_min_words(F.col("adv_text"), least_words))


def clean_stream(spark: SparkSession, source: str, schema: T.StructType, sink: str, progress: str,
                 files_per_batch: int = 1000) -> None:
    """Read what has arrived in ``source`` since the last run, clean it, append it to ``sink``.

    ``progress`` holds the stream's own checkpoint, so a restarted run neither skips nor repeats files.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = (cleaned(arriving).writeStream.format("parquet").option("path", sink)
           .option("checkpointLocation", progress).trigger(availableNow=True).start())
    run.awaitTermination()
