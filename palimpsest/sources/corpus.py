"""Corpora: CSV with declared schemas, partitioned parquet, raw snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.schema import KINDS, LABEL, LABEL_ALIASES, NULL_TOKENS, SENT
from palimpsest.sources import files

LAYOUT = ["dataset", "split", "system", "setting", "level"]
_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_corpus(spark: SparkSession, path: str | list[str], kind: str = "pairs", multi_line: bool = True) -> DataFrame:
    """Header CSV as a table of the declared schema.

    Columns are found by name, in any order; one that a file lacks becomes null. ``Class`` and
    ``Intent`` are read as the label. All cells are read as text first, so that a null token in a
    number column is null and not an error. Quoted texts may hold line ends: a file is then read
    by one task, so large corpora should come as many files (write_corpus sees to that).
    """
    header = spark.read.options(**_CSV, multiLine=multi_line).csv(path)   # names from the first line only
    cells = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    raw = spark.read.options(**_CSV, multiLine=multi_line).schema(cells).csv(path)
    names = {c.strip(): c for c in raw.columns}
    if LABEL not in names:
        names |= {LABEL: names[a] for a in LABEL_ALIASES if a in names}
    out = []
    for field in KINDS[kind].fields:
        found = names.get(field.name)
        cell = F.lit(None).cast("string") if found is None else F.col(f"`{found}`")
        cell = F.when(~cell.isin(*NULL_TOKENS), cell)
        out.append((cell if isinstance(field.dataType, T.StringType) else cell.try_cast(field.dataType)).alias(field.name))
    return raw.select(*out)


def read_legacy(spark: SparkSession, path: str | list[str], kind: str = "pairs") -> DataFrame:
    """All CSV files below ``path``, each with its own header, as the declared schema with ``file`` and ``row``.

    ``row`` is the position in the file, from 0; where a file has no ``sent_id`` it stands for it, so no row lacks a key. See ``files``.
    """
    rows, _ = files.read_files(spark, path)
    label = F.coalesce(*[F.when(F.array_contains("names", a), F.lit(a)) for a in (LABEL, *LABEL_ALIASES)])
    out = []
    for field in KINDS[kind].fields:
        text = files.cell(label if field.name == LABEL else field.name)
        text = F.when(~text.isin(*NULL_TOKENS), text)
        value = text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)
        out.append((F.coalesce(value, F.col("row")) if field.name == SENT else value).alias(field.name))
    return rows.select(*out, "file", "row")


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    (writer.options(**_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                    maxRecordsPerFile=rows_per_file).csv(path))


def write_corpus(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Parquet, one folder per value of ``partitions``; only the folders that ``df`` fills are replaced.

    Rows are rebalanced by folder first, so that a folder gets few files and not one from every task;
    a folder that holds a large part of the rows is split over several tasks again.
    """
    partitions = LAYOUT if partitions is None else partitions
    placed = df.hint("rebalance", *partitions) if partitions else df
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_layout(spark: SparkSession, path: str, schema: T.StructType, **wanted: str) -> DataFrame:
    """A written corpus; ``wanted`` values prune folders before any file is opened."""
    out = spark.read.schema(schema).parquet(path)
    for name, value in wanted.items():
        out = out.where(F.col(name) == value)
    return out


# The older file-name pattern
# {dataset}_{split}_{original|obfuscated_{setting}}[_sentences][_raw].csv
_NAME = r"([^/]+)_(train|test|val)_(original|obfuscated_(.+?))(_sentences)?(_raw)?(\.csv)?$"


def legacy_name(name: Column) -> list[Column]:
    """Layout columns out of an older file name (or path)."""
    part = lambda g: F.regexp_extract(name, _NAME, g)
    return [
        part(1).alias("dataset"), part(2).alias("split"),
        F.when(part(3) == "original", F.lit("original")).otherwise(part(4)).alias("setting"),
        F.when(part(5) != "", "sent").otherwise("doc").alias("level"),
        (part(6) != "").alias("raw"),
    ]


def import_legacy(spark: SparkSession, path: str | list[str], system: str, kind: str = "pairs") -> DataFrame:
    """All CSV files below ``path``, whatever their column orders, with the layout columns taken from their names.

    A folder of part files counts as one file of the folder's name, if that ends in ``.csv``.
    """
    folder = F.regexp_extract("file", r"([^/]+\.csv)/", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract("file", r"([^/]+)$", 1))
    table = read_legacy(spark, path, kind).withColumn("_name", name)
    return table.select("*", F.lit(system).alias("system"), *legacy_name(F.col("_name"))).drop("file", "row", "_name")


def snapshot_raw(spark: SparkSession, raw_path: str, clean_path: str, clean, incoming: DataFrame | None = None) -> DataFrame:
    """Keep the raw table as it first came, and write ``clean(raw)`` over the clean table.

    ``incoming`` is stored only if no complete raw table is there yet (one whose write was committed); cleaning always
    starts from the raw table, so a second run changes nothing.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{raw_path}/_SUCCESS")
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    if not there:
        if incoming is None:
            raise FileNotFoundError(raw_path)
        incoming.write.mode("overwrite").parquet(raw_path)   # also over what a failed write has left
    clean(spark.read.parquet(raw_path)).write.mode("overwrite").parquet(clean_path)
    return spark.read.parquet(clean_path)
