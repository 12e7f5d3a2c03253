"""Nothing is lost without an error, and no run's scores depend on another run."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import metrics as mt
from palimpsest.operators import pairing, results, trees
from palimpsest.plans import models as md
from palimpsest.plans.quality import paired_documents, quality_report
from palimpsest.sources import corpus
from palimpsest.workspace import fresh_path


def runs(spark):
    texts = ["the cat sat on the mat and slept", "a dog ran over the green hill today", "she said that it was late already"]
    rows = [(m, "t0", i, 0, t, t.replace("the", w), i % 2) for m, w in (("m1", "a"), ("m2", "zebra zebra")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "model string, temperature string, doc_id long, sent_id long, text string, adv_text string, label int")


def test_a_run_scores_the_same_alone_and_among_others(spark):
    pairs, by = runs(spark), ["model", "temperature"]
    report = lambda df: {(r.metric, r.label_group): r.value for r in quality_report(df, [*by, "doc_id", "sent_id"], by).where("model = 'm1'").collect()}
    both, alone = report(pairs), report(pairs.where("model = 'm1'"))
    assert both == alone and ("perplexity", "ALL") in both


def test_documents_are_measured_as_documents(spark):
    pairs = runs(spark).withColumn("doc_id", F.lit(7).cast("long")).withColumn("sent_id", F.col("label") + F.length("text")).withColumn("label", F.lit(1))
    docs = paired_documents(pairs, ["model", "temperature"]).collect()
    assert len(docs) == 2 and all(r.text.count(".") == 2 and r.adv_text.count(".") == 2 for r in docs)


def lose(parts):
    parts = list(parts)
    yield parts[0]


def shorten(parts):
    for p in parts:
        yield p.iloc[1:]


@pytest.mark.parametrize("rewriter", [lose, shorten])
def test_a_rewriter_that_loses_rows_is_an_error(spark, rewriter):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        with pytest.raises(Exception, match="rewriter"):
            md.batch_generate(spark.range(100).select(F.col("id").cast("string").alias("text")).coalesce(1), rewriter=rewriter).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_predictions_that_are_no_class_count_as_wrong(spark):
    rows = spark.createDataFrame([(1, 1), (1, None), (0, 2), (None, 0)], "y int, yhat int")
    assert mt.binary_metrics(rows).first().accuracy == 0.25


def test_labels_of_any_size(spark):
    rows = spark.createDataFrame([("123456",), ("-1",), ("AD",), ("x",)], "label string")
    got = [r.n for r in rows.select(pairing.label_numbers(F.col("label"), {1: "AD"}).alias("n")).collect()]
    assert got == [123456, -1, 1, None]


def test_the_latest_value_is_shown_and_names_do_not_run_together(spark):
    rows = [("k", "SVM", "sent_f1", 1.0, 1), ("k", "SVM_sent", "f1", 2.0, 1), ("k", "SVM_sent", "f1", 3.0, 2)]
    wide = results.pivot_results(spark.createDataFrame(rows, "key string, classifier string, metric string, value double, version long"), ["key"], [("SVM_sent", "f1")])
    assert wide.first()["SVM_sent_f1"] == 3.0


def test_a_half_written_raw_table_is_written_again(spark):
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    rows.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(raw)   # no mark of success
    out = corpus.snapshot_raw(spark, raw, clean, lambda df: df, rows)
    assert out.count() == 2


def test_long_tags_keep_their_name(spark):
    html = spark.createDataFrame([("<" + "a" * 2_000_000 + ">",)], "html string")
    assert len(html.select(trees.tag_marks(F.col("html")).alias("m")).first().m[0]) == 2_000_001


def test_text_classifier_takes_slots(spark):
    rows = spark.createDataFrame(pd.DataFrame({"text": ["good words here", "bad words there"] * 10, "label": [1, 0] * 10, "side": ["s"] * 20}))
    found = md.static_adversary(rows, rows, ["side"], ["LR"], slots=1 << 8).collect()
    assert {r.metric: r.value for r in found}["Accuracy"] == 1.0 and len(found) == 8
