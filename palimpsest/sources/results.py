"""Result tables with a two-line header."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import NULL_TOKENS
from palimpsest.sources.files import read_rows


def write_two_level(wide: DataFrame, path: str, keys: list[str], cells: list[tuple[str, str]]) -> None:
    """CSV files that each begin with the lines ``key…,classifier…`` and ``,…,metric…``.

    ``wide`` has the key columns and one column ``classifier_metric`` per cell.
    """
    columns = [*keys, *[f"{c}_{m}" for c, m in cells]]
    head = [[*keys, *[c for c, _ in cells]], [*["" for _ in keys], *[m for _, m in cells]]]

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for part in parts:
            out = io.StringIO()
            writer = csv.writer(out, lineterminator="\n")
            if first:
                writer.writerows(head)
                first = False
            writer.writerows(part.astype(object).where(part.notna(), "").itertuples(index=False))
            yield pd.DataFrame({"value": [out.getvalue().rstrip("\n")]})

    wide.select(*columns).mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def read_two_level(spark: SparkSession, path: str) -> DataFrame:
    """Long table (keys, classifier, metric, value). Only the two header lines reach the driver. Keys may hold line ends.

    A column whose second line is blank or ``Unnamed…`` is a key; the rest are cells. Rows that
    repeat a header are dropped; cells without a value give no row.
    """
    table = read_rows(spark, path)
    first, second = (table.where(F.col("row") == k).first().cells for k in (0, 1))
    is_key = [s.strip() == "" or s.startswith("Unnamed") for s in second]
    body = table.select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(first))])
    clean = lambda i: F.when(~F.col(f"c{i}").isin(*NULL_TOKENS), F.col(f"c{i}"))
    lead = [i for i, k in enumerate(is_key) if k]
    cells = [i for i, k in enumerate(is_key) if not k]
    # neither header line is data: the first repeats the key names, the second has no key at all
    is_head = F.lit(True)
    for i in lead:
        is_head = is_head & F.col(f"c{i}").eqNullSafe(F.lit(first[i]))
    any_key = F.coalesce(*[clean(i) for i in lead]).isNotNull()
    rows = body.where(~is_head & any_key)
    long = F.array(*[F.struct(F.lit(first[i]).alias("classifier"), F.lit(second[i]).alias("metric"),
                              clean(i).try_cast("double").alias("value")) for i in cells])
    return rows.select(*[clean(i).alias(first[i]) for i in lead], F.inline(long)).where("value IS NOT NULL")
