"""Python code of the caller inside Spark jobs: text to rows, and text to score."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_texts(df: DataFrame, keys: list[str], text: str, processor: Callable[[str], Iterable[tuple]],
                  schema: T.StructType) -> DataFrame:
    """Rows that ``processor`` gives for each text, with the keys of the text's row.

    A table function: it runs in the tasks that hold the rows and moves no data. Null texts give no rows.
    """
    class Process:
        def eval(self, value: str):
            if value is not None:
                yield from processor(value)

    table = F.udtf(Process, returnType=schema)
    return df.lateralJoin(table(F.col(text).outer())).select(*keys, *schema.names)


Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def score_texts(df: DataFrame, text: str, scorer: Scorer, name: str = "score") -> DataFrame:
    """One number per text. ``scorer`` takes and gives an iterator of batches, so that a model is
    loaded once per Python worker."""
    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scorer(parts)

    return df.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))
