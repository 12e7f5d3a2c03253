"""Queries: streams over the file source, run until what has arrived is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators.results import concat_results
from palimpsest.plans import fixtures as fx
from palimpsest.plans.catalog import query, s_words, using
from palimpsest.plans.q_alignment import _CHANGED, UPSERTED, _changed, _RESULT_KEYS
from palimpsest.plans.q_cleaning import CLEANED
from palimpsest.streaming.clean import clean_stream
from palimpsest.streaming.upsert import current, upsert_stream
from palimpsest.workspace import fresh_path


@query("clean_stream", using("v_raw", f"SELECT * FROM cleaned WHERE len({s_words('adv_text')}) >= 3", cleaned=CLEANED))
def clean_as_it_arrives(spark, sf):
    source, sink, progress = (fresh_path(spark, f"clean-{n}") for n in ("source", "sink", "progress"))
    raw = fx.raw_generations(spark, sf)
    raw.write.parquet(source)
    clean_stream(spark, source, raw.schema, sink, progress)
    return spark.read.parquet(sink).select("doc_id", "sent_id", "system", "setting", "adv_text")


@query("upsert_stream", using("v_results", UPSERTED, changed=_CHANGED))
def upsert_as_it_arrives(spark, sf):
    source, table, progress = (fresh_path(spark, f"upsert-{n}") for n in ("source", "table", "progress"))
    old, new = fx.results(spark, sf), _changed(spark, sf)
    schema = old.select(*_RESULT_KEYS, "value", "version").schema
    for part in (new, old):   # the older rows come last and must not win
        part.select(*_RESULT_KEYS, "value", "version").write.mode("append").parquet(source)
        upsert_stream(spark, source, schema, table, progress, _RESULT_KEYS)
    return current(spark, table, schema, _RESULT_KEYS).withColumn("value", F.round("value", 6))
