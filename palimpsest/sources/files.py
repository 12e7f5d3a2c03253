"""CSV files as they come: each with its own header and column order, quoted cells with line ends, rows numbered by file.

A file is read in splits, however large. A line starts a row if the quotes before it in its file are even, so a first pass counts quotes and lines
of each split, and the number of rows that start in it for either case. Running sums over the splits of a file then give
each split's case and its first row number. The second pass puts rows together while it reads; only rows that go on
beyond a split meet by a shuffle, at most one at each end of a split. No window goes over rows, and no file is read by one task.

Defined cases: blank lines are no rows; a last row with an open quote ends with its file; missing cells are null, cells beyond the header are
ignored; of two columns with one name the first counts; an empty file, or one with a header alone, gives no rows.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.workspace import stored

MANY = 1_000_000  # splits, or files, up to which their numbers (some 40 bytes each) are copied to all tasks
_ROW = "file string, row long, cells array<string>, at long, part string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(file, block and further columns of a split, its lines so far): pieces of splits in the order of the scan."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "value"]
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        values = batch.column(batch.schema.get_field_index("value")).to_pylist()
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or any(columns[k][i] != columns[k][first] for k in (0, 1)):
                yield [c[first] for c in columns], values[first:i]
                first = i


def _is_blank(line: str) -> bool:
    return not line.strip("\r")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, sums = None, [0, 0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([split[0]]), pa.array([split[1]], pa.int64()), *(pa.array([x], pa.int64()) for x in sums)], ["file", "block", "quotes", "even", "odd"])
    for here, lines in _walk(batches):
        if here != split:
            if split:
                yield row()
            split, sums = here, [0, 0, 0]
        for line in lines:
            if not _is_blank(line):
                sums[1 + sums[0] % 2] += 1  # starts a row if the quotes before the split are even, or if they are odd
            sums[0] += line.count('"')
    if split:
        yield row()


def split_offsets(lines: DataFrame) -> DataFrame:
    """(file, block, inside, first): whether the split starts inside a quoted cell, and the number of its first row."""
    counts = stored(lines.mapInArrow(_count, "file string, block long, quotes long, even long, odd long"), "splits")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)   # one row a split
    known = counts.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    starts = known.withColumn("rows", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    return stored(starts.select("file", "block", "inside", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")), "split-offsets")


def cells_of(row: str) -> list[str]:
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([row.removesuffix("\r")], quotechar='"', doublequote=True), [])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, number, inside, held, owned = None, 0, 0, [], True
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "row", "cells", "at", "part"])
    for here, lines in _walk(batches):
        if split is None or here[:2] != split[:2]:
            if held:
                out.append((split[0], number, None, split[1], "\n".join(held)))
            split, held = here, []
            inside, number = here[2], here[3] - 1
            owned = not inside
        for line in lines:
            if not inside and _is_blank(line):
                continue
            if not inside:
                number, held, owned = number + 1, [], True
            held.append(line)
            inside = (inside + line.count('"')) % 2
            if not inside:
                text = "\n".join(held)
                out.append((split[0], number, cells_of(text), None, None) if owned else (split[0], number, None, split[1], text))
                held = []
        if len(out) >= 1000:
            yield batch()
            out = []
    if held:
        out.append((split[0], number, None, split[1], "\n".join(held)))
    yield batch()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [cells_of(text) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], ["file", "row", "cells"])


def _copied(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MANY else df


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row, cells) of all files below ``path``; row 0 of a file is its header."""
    lines = _lines(spark, path)
    offsets = split_offsets(lines)
    if offsets.count() > MANY:
        raise ValueError(f"more than {MANY} splits: raise spark.sql.files.maxPartitionBytes")
    # a broadcast join keeps the order of the scan, which the rows are put together in
    placed = lines.join(F.broadcast(offsets), ["file", "block"]).select("file", "block", "inside", "first", "value")
    read = stored(placed.mapInArrow(_rows, _ROW), "csv-rows")
    parts = read.where("part IS NOT NULL").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    texts = parts.select("file", "row", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("text"))
    return read.where("part IS NULL").select("file", "row", "cells").unionByName(texts.mapInArrow(_joined, "file string, row long, cells array<string>"))


def read_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (file, row, cells), numbered from 0 behind the header, with the names of their file's columns; and the headers (file, names)."""
    rows = read_rows(spark, path)
    names = F.transform("cells", lambda c: F.trim(F.regexp_replace(c, "^﻿", "")))
    headers = stored(rows.where("row = 0").select("file", names.alias("names")), "headers")
    return rows.where("row > 0").select("file", (F.col("row") - 1).alias("row"), "cells").join(_copied(headers), "file"), headers


def cell(name: str | Column) -> Column:
    """A cell of a row by the name of its column; null where the file has no such column."""
    return F.get(F.col("cells"), F.array_position("names", F.lit(name) if isinstance(name, str) else name).cast("int") - 1)
