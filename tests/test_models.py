"""Classifiers, generation and the whole evaluation."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.plans import models as md
from palimpsest.plans import q_models
from palimpsest.plans.quality import DEFAULT_METRICS
from palimpsest.schema import RESULT_KEYS
from palimpsest.workspace import fresh_path
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, f"good fine nice word{i % 7}" if i % 2 else f"bad poor sad word{i % 5}", i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").persist()


@pytest.mark.parametrize("name,feature", [("SVM", "TFIDF"), ("SVM", "BOW"), ("LR", "TFIDF"), ("RF", "TFIDF")])
def test_classifiers_separate_toy_texts(toy, name, feature):
    model = md.fit_classifier(toy, name, feature, slots=1 << 10)
    assert md.predict(model, toy).where("pred <> label").count() == 0


def test_tfidf_features(spark):
    texts = spark.createDataFrame([("aa bb bb",), ("aa cc",)], "text string")
    counted = PipelineModel(md.count_stages(1 << 16)).transform(md._prepared(texts, "text"))
    stages, rows = md.weight_stages(counted, "TFIDF", 1 << 16)
    first = PipelineModel(stages).transform(counted).first().features
    a, b = 1.0, 2 * (math.log(3 / 2) + 1)
    assert rows == 2 and sorted(first.values) == [pytest.approx(a / math.hypot(a, b)), pytest.approx(b / math.hypot(a, b))]


def test_save_and_load(spark, toy):
    model = md.fit_classifier(toy, "LR", slots=1 << 10)
    path = fresh_path(spark, "model")
    md.save_model(model, path)
    a, b = (md.formality(m, toy, "text").orderBy("doc_id").collect() for m in (model, md.load_model(path)))
    assert a == b and all((r.formality > 0.5) == bool(r.label) for r in a)


def test_batch_generate_keeps_rows_and_keys(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "k long, text string").repartition(4)
    loads = spark.sparkContext.accumulator(0)

    def shout(parts):
        loads.add(1)
        for texts in parts:
            yield pd.Series([t.upper() for t in texts])

    got = md.batch_generate(rows, rewriter=shout).collect()
    assert sorted((r.k, r.adv_text) for r in got) == [(i, f"TEXT {i}") for i in range(500)]
    assert loads.value == 4   # once per partition, not per batch
    assert md.batch_generate(spark.createDataFrame([("I, I see",)], "text string")).first().adv_text == "I see"


def test_batch_generate_reads_whole_texts(spark, tmp_path):
    texts = ["\u00e9an autre the the caf\u00e9", "The stra\u00dfe an \u00fcber", "l'a the\u0301 na\u00efve a", "\u00fca b \u00e4the c _a d 1a e"]
    rows = [(i, t, role, text) for i, text in enumerate(texts) for t, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["batch_generate_whole"](spark, str(tmp_path))
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(texts))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert differences(got, con, entry.oracle_sql()["batch_generate_whole"]) == []


def test_training_pairs(spark):
    rows = spark.createDataFrame([(1, " a  b c", None, 1), (2, None, "x", 0)], "k long, t string, a string, l int")
    got = md.training_pairs(rows, ["k"], "t", "a", "l", n=2).collect()
    assert [tuple(r) for r in got] == [(1, "a b", "", 1.0)]


def test_evaluate_systems(spark):
    found = entry.queries()["evaluate_systems"](spark, SF).collect()
    assert set(RESULT_KEYS) < set(found[0].asDict())
    kinds = {(r.model, r.temperature, r.classifier) for r in found}
    assert ("Original", "None", "SVM_sent") in kinds and ("rewriter", "t1", "ADA_SVM_sent") in kinds
    assert ("rewriter", "t0", "quality_ALL") in kinds
    assert len({tuple(r[k] for k in RESULT_KEYS) for r in found}) == len(found)


def test_knobs_are_scored_on_the_same_documents(spark):
    rows = entry.queries()["static_adversary"](spark, SF).collect()
    assert {(r.model, r.temperature) for r in rows} == {("Original", "None"), ("rewriter", "t0"), ("rewriter", "t1")}
    assert all(-1 <= r.value <= 1 for r in rows) and {r.metric for r in rows} == set(md._METRIC_NAMES.values())


FAST = {   # the same names, few steps
    "SVM": lambda feature, rows: LinearSVC(maxIter=1), "RF": lambda feature, rows: RandomForestClassifier(numTrees=1, maxDepth=1, seed=1),
    "LR": lambda feature, rows: LogisticRegression(maxIter=1)}


def test_adaptive_adversary_covers_every_knob_and_classifier(spark, monkeypatch):
    assert FAST.keys() == md.CLASSIFIERS.keys()
    monkeypatch.setattr(md, "CLASSIFIERS", FAST)
    rows = entry.queries()["adaptive_adversary"](spark, SF).collect()
    want = {("rewriter", t, f"ADA_{c}", m) for t in ("t0", "t1") for c in FAST for m in md._METRIC_NAMES.values()}
    assert sorted((r.system, r.temperature, r.classifier, r.metric) for r in rows) == sorted(want)


@pytest.mark.parametrize("name", ["evaluate_systems", "evaluate_systems_doc"])
def test_evaluation_runs_every_classifier_and_metric(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(q_models, "evaluate_systems", lambda *args: seen.append(args))
    entry.queries()[name](spark, SF)
    assert seen[0][4] == list(md.CLASSIFIERS) and seen[0][5] == DEFAULT_METRICS
    assert seen[0][7] == ("doc" if name.endswith("doc") else "sent")


@pytest.mark.parametrize("name,before", [("RF", 1 << 12)])
def test_a_term_that_decides_keeps_a_slot_of_its_own_among_a_million(spark, name, before):
    at, now = HashingTF(inputCol="w", outputCol="v", numFeatures=1 << 20).indexOf, md.TERM_SLOTS[name]
    mine = at("decisive")   # slots of fewer bits are its last bits; hash() gives the same for whole groups of four bytes
    slot = F.pmod(F.hash("term"), F.lit(1 << 20))
    other = spark.range(1_000_000).select(F.format_string("term%08d", "id").alias("term")).where(
        (slot % before == mine % before) & (slot % now != mine % now)).first().term
    assert at(other) % before == mine % before
    rows = [(i, f"{'decisive' if i % 2 else other} word{i % 7}", i % 2) for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert md.predict(md.fit_classifier(texts, name), texts).where("pred <> label").count() == 0
