"""Predictions as JSON, and identifiers from padded text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_OBJECT = 1000


def prediction_rows(df: DataFrame, row: str = "row_id", pred: str = "pred") -> DataFrame:
    """One JSON object per row: ``{"17":1}``."""
    pair = F.create_map(F.col(row).cast("string"), F.col(pred).cast("int"))
    return df.select(F.to_json(pair).alias("value"))


def write_predictions(df: DataFrame, path: str, row: str = "row_id", pred: str = "pred") -> None:
    prediction_rows(df, row, pred).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, pred) rows, from files with one object per line of any number of entries."""
    entries = F.from_json("value", T.MapType(T.StringType(), T.IntegerType()))
    return (spark.read.text(path).select(F.explode(entries).alias("_k", "pred"))
            .select(F.col("_k").cast("long").alias("row_id"), "pred"))


def prediction_objects(df: DataFrame, row: str = "row_id", pred: str = "pred",
                       rows_per_object: int = ROWS_PER_OBJECT) -> DataFrame:
    """JSON objects of bounded size, in row order: object k holds rows k*size … (k+1)*size - 1.

    Row numbers are unique, so no object holds more than ``rows_per_object`` entries; a single
    object for all rows would have to pass through one task.
    """
    part = F.floor(F.col(row) / F.lit(rows_per_object)).cast("long")
    gathered = df.groupBy(part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(pred).cast("int").alias("p")))).alias("_all"))
    entries = F.transform("_all", lambda e: F.struct(e["r"].cast("string").alias("key"), e["p"].alias("value")))
    return gathered.select("part", F.to_json(F.map_from_entries(entries)).alias("json"))


def read_id_file(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated text with padded headings and values; all columns text, trimmed."""
    raw = spark.read.options(header=True, sep=";").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])


def attach_ids(predictions: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The one identifier of each prediction's row."""
    return predictions.join(ids, on)
