"""Streams give what the batch jobs give, whatever the order and number of runs."""

from palimpsest.functions.answers import PHI3
from palimpsest.operators.results import latest_rows
from palimpsest.streaming.clean import clean_stream, cleaned
from palimpsest.streaming.upsert import current, upsert_stream
from palimpsest.workspace import fresh_path

RAW = "i long, system string, setting string, raw_text string"
ROWS = "model string, temperature string, value double, version long"


def test_clean_stream_takes_up_where_it_stopped(spark):
    source, sink, progress = (fresh_path(spark, n) for n in ("source", "sink", "progress"))
    parts = [[(i, PHI3, "KB", f'"Output: answer number {i}. More" (x)') for i in range(5)],
             [(9, PHI3, "KB", "too short"), (10, PHI3, "KB", None), (11, "other", "KB", "kept as it is")]]
    everything = []
    for part in parts:
        df = spark.createDataFrame(part, RAW)
        df.write.mode("append").parquet(source)
        everything += part
        clean_stream(spark, source, df.schema, sink, progress)
        got = spark.read.parquet(sink).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, cleaned(spark.createDataFrame(everything, RAW)).collect()))
    clean_stream(spark, source, spark.createDataFrame(everything, RAW).schema, sink, progress)
    assert spark.read.parquet(sink).count() == len(got) == 6


def test_upsert_stream(spark):
    source, table, progress = (fresh_path(spark, n) for n in ("source", "table", "progress"))
    batches = [[("a", "t", 1.0, 1), ("b", "t", 2.0, 1)], [("a", "t", 5.0, 3)], [("a", "t", 4.0, 2), ("c", "t", 7.0, 1)]]
    keys = ["model", "temperature"]
    for rows in batches:
        df = spark.createDataFrame(rows, ROWS).coalesce(1)
        df.write.mode("append").parquet(source)
    upsert_stream(spark, source, df.schema, table, progress, keys)
    got = sorted(map(tuple, current(spark, table, df.schema, keys).collect()))
    every = spark.createDataFrame([r for b in batches for r in b], ROWS)
    assert got == sorted(map(tuple, latest_rows(every, keys).collect())) == [("a", "t", 5.0, 3), ("b", "t", 2.0, 1), ("c", "t", 7.0, 1)]
