"""Readers, writers and result tables."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import pairing, results
from palimpsest.sources import corpus, predictions, runs
from palimpsest.sources import results as two_level
from palimpsest.workspace import durable, fresh_path, remove, shared_dir, stored, tracked

KEYS = ["model", "temperature"]


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Text,Class,doc_ID,AdvText\n"I, I went",1,4,nan\n"say ""x""\nmore",0,5,NULL\n,1,,ok\n')
    rows = corpus.read_corpus(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0].asDict() == {"Text": "I, I went", "AdvText": None, "Label": 1, "doc_ID": 4, "sent_id": None}
    assert rows[1].Text == 'say "x"\nmore' and rows[2].Text is None and rows[2].AdvText == "ok" and rows[2].doc_ID is None


def test_import_legacy(spark, tmp_path):
    for name in ("Mock_test_obfuscated_KB_sentences.csv", "Mock_test_obfuscated_KB_sentences_raw.csv"):
        (tmp_path / name).write_text("Text,AdvText,Label,doc_ID\na,b,0,1\n")
    rows = corpus.import_legacy(spark, str(tmp_path), "sys").collect()
    assert {(r.dataset, r.split, r.setting, r.level, r.raw, r.system) for r in rows} == {
        ("Mock", "test", "KB", "sent", False, "sys"), ("Mock", "test", "KB", "sent", True, "sys")}


def test_layout_prunes_folders(spark):
    table = spark.createDataFrame([("t", "d", s, "sys", k, "sent") for s in ("train", "test") for k in ("KB", "ZS")],
                                  "text string, dataset string, split string, system string, setting string, level string")
    path = fresh_path(spark, "test-layout")
    corpus.write_corpus(table, path)
    read = corpus.read_layout(spark, path, table.schema, split="test", setting="KB")
    assert read.count() == 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_snapshot_raw_keeps_the_first_raw(spark):
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    step = lambda d: d.select(F.concat("t", F.lit("!")).alias("t"))
    with pytest.raises(FileNotFoundError):
        corpus.snapshot_raw(spark, raw, clean, step)
    corpus.snapshot_raw(spark, raw, clean, step, spark.createDataFrame([("a",)], "t string"))
    again = corpus.snapshot_raw(spark, raw, clean, step, spark.createDataFrame([("other",)], "t string"))
    assert [r.t for r in again.collect()] == ["a!"]


def test_two_level_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Model,Temperature,SVM,SVM,BERT\n,Unnamed: 1_level_1,Accuracy,F1-score,Accuracy\nm,None,0.5,,0.25\n")
    got = {(r.Model, r.Temperature, r.classifier, r.metric, r.value) for r in two_level.read_two_level(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {("m", "None", "SVM", "Accuracy", 0.5), ("m", "None", "BERT", "Accuracy", 0.25)}


def test_two_level_round_trip_over_many_files(spark):
    rows = [(f"m{i}", "t", "C", "x", i / 8, 1) for i in range(20)]
    long = spark.createDataFrame(rows, "model string, temperature string, classifier string, metric string, value double, version long")
    wide = results.pivot_results(long, KEYS, [("C", "x"), ("C", "y")]).repartition(5)
    path = fresh_path(spark, "two-level")
    two_level.write_two_level(wide, path, KEYS, [("C", "x"), ("C", "y")])
    got = sorted((r.model, r.value) for r in two_level.read_two_level(spark, path).collect())
    assert got == sorted((r[0], r[4]) for r in rows)


def test_upsert(spark):
    schema = "model string, temperature string, value double, version long"
    old = spark.createDataFrame([("a", "t", 1.0, 1), ("b", "t", 2.0, 1)], schema)
    new = spark.createDataFrame([("a", "t", 9.0, 2), ("a", "u", 3.0, 2)], schema)
    once = results.upsert_results(old, new, KEYS)
    twice = results.upsert_results(once, new, KEYS)
    want = [("a", "t", 9.0, 2), ("a", "u", 3.0, 2), ("b", "t", 2.0, 1)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    assert sorted(map(tuple, results.upsert_results(new, old, KEYS).collect())) == want   # order of arrival does not count


def test_prediction_files(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(25)], "row_id long, pred int")
    path = fresh_path(spark, "pred")
    predictions.write_predictions(rows, path)
    assert sorted(map(tuple, predictions.read_predictions(spark, path).collect())) == [(i, i % 2) for i in range(25)]
    objects = predictions.prediction_objects(rows, rows_per_object=10).orderBy("part").collect()
    assert [r.part for r in objects] == [0, 1, 2] and objects[2].json == '{"20":0,"21":1,"22":0,"23":1,"24":0}'


def test_id_file(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("ID   ; age\nS1  ; 70\nS2  ;81 \n")
    ids = predictions.read_id_file(spark, str(tmp_path / "ids.txt"))
    assert ids.columns == ["ID", "age"] and [tuple(r) for r in ids.collect()] == [("S1", "70"), ("S2", "81")]


def test_run_grid(spark):
    config = '{"a": {"project_dir": "None", "temperatures": ["None", "1.5"], "level": "doc"}, "b": {"temperatures": ["x"], "level": "sent"}}'
    grid = runs.run_grid(spark.createDataFrame([(config, ["D"])], "c string, d array<string>"), "c", "d", ["SVM", "SVM_sent"])
    got = {(r.system, r.temperature, r.classifier): (r.runnable, r.project_dir) for r in grid.collect()}
    assert got == {("a", "None", "SVM"): (True, None), ("a", "None", "SVM_sent"): (False, None), ("a", "1.5", "SVM"): (True, None),
                   ("a", "1.5", "SVM_sent"): (False, None), ("b", "x", "SVM"): (True, None), ("b", "x", "SVM_sent"): (True, None)}


def test_select_side_and_training_set(spark):
    pairs = spark.createDataFrame([("a b c d", "x", 0), (None, "y", 1), ("a b", None, 1)], "Text string, AdvText string, Label int")
    assert pairing.select_side(pairs, "rewritten").columns == ["Text", "Label"]
    assert pairing.select_side(pairs.drop("AdvText"), "rewritten").columns == ["Text", "Label"]
    with pytest.raises(ValueError):
        pairing.select_side(pairs, "both")
    both = pairing.adaptive_training_set(pairs, pairs.select(F.col("AdvText").alias("Text"), "Label"))
    assert sorted((r.Text, r.side, r.AdvText) for r in both.collect() if r.AdvText) == [("a b c d", "original", "x")]
    assert sorted(r.Text for r in both.where("side = 'rewritten'").collect()) == ["x", "y"]


def test_remove_stopwords_keeps_repeats(spark):
    rows = spark.createDataFrame([("the",), ("dog",), ("dog",)], "w string")
    assert [r.w for r in pairing.remove_stopwords(rows, "w").collect()] == ["dog", "dog"]
    assert [r.w for r in pairing.remove_stopwords(rows, "w", spark.createDataFrame([("dog",)], "x string")).collect()] == ["the"]


def test_label_names_both_ways(spark):
    names = {0: "cc", 1: "ad"}
    rows = spark.createDataFrame([("0",), ("ad",)], "l string")
    named = rows.select(pairing.label_names(F.col("l"), names).alias("n"))
    assert [r.n for r in named.collect()] == ["cc", "ad"]
    assert [r[0] for r in rows.select(pairing.label_numbers(F.col("l"), names)).collect()] == [0, 1]


def test_scratch_lies_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == base and fresh_path(spark, "x").startswith(base)
    df = durable(spark.range(5))
    assert df.count() == 5 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert stored(spark.range(5), "t").count() == 5


def test_two_level_keys_with_line_ends(spark):
    path = fresh_path(spark, "two-level")
    long = spark.createDataFrame([('m "q"\nx', "t,\r\n1", "C", "x", 0.5), ("plain", "t", "C", "x", 0.25)], "model string, temperature string, classifier string, metric string, value double")
    two_level.write_two_level(results.pivot_results(long, KEYS, [("C", "x")]), path, KEYS, [("C", "x")])
    got = sorted((r.model, r.temperature, r.value) for r in two_level.read_two_level(spark, path).collect())
    assert got == [('m "q"\nx', "t,\r\n1", 0.5), ("plain", "t", 0.25)]


def test_columns_of_one_name_are_refused(spark):
    table = spark.createDataFrame([("m", "SVM", "sent_f1", 1.0)], "model string, classifier string, metric string, value double")
    with pytest.raises(ValueError, match="SVM_sent_f1"):
        results.pivot_results(table, ["model"], [("SVM", "sent_f1"), ("SVM_sent", "f1")])


def test_tracked_paths_can_be_removed(spark):
    table = spark.range(3)
    with tracked() as made:
        inner = stored(table, "inner")
        with tracked() as deeper:
            kept = stored(table, "kept")
    outer = stored(table, "outer")
    assert len(made) == 2 and len(deeper) == 1 and kept.count() == 3
    remove(spark, [p for p in made if p not in deeper])
    assert kept.count() == outer.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        inner.count()
