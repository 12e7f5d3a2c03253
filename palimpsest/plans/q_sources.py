"""Queries: writing and reading back corpora, results, predictions and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as tx
from palimpsest.operators import results
from palimpsest.plans import fixtures as fx
from palimpsest.plans.catalog import NOT_WS, query, s_markup, using
from palimpsest.schema import NULL_TOKENS
from palimpsest.sources import corpus, predictions, runs
from palimpsest.sources import results as two_level
from palimpsest.workspace import fresh_path

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


@query("read_corpus", using("v_pair_null", f"""
    SELECT CASE WHEN text NOT IN ({_TOKENS}) THEN text END AS "Text",
           CASE WHEN adv_text NOT IN ({_TOKENS}) THEN adv_text END AS "AdvText", label AS "Label", doc_id AS "doc_ID", sent_id
    FROM v_pair_null"""))
def read_corpus(spark, sf):
    """Written with another column order, another label name and spelt-out nulls, then read back."""
    path = fresh_path(spark, "corpus-csv")
    table = fx.pairs_null(spark, sf).select(
        F.col("label").alias("Class"), F.coalesce("adv_text", F.lit("NaN")).alias("AdvText"), "sent_id",
        F.col("text").alias("Text"), F.col("doc_id").alias("doc_ID"))
    corpus.write_csv(table, path)
    return corpus.read_corpus(spark, path, "pairs")


@query("import_legacy", using("v_pair_null", f"""
    SELECT CASE WHEN t NOT IN ({_TOKENS}) THEN t END AS "Text", CASE WHEN adv_text NOT IN ({_TOKENS}) THEN adv_text END AS "AdvText", label AS "Label",
           doc_id AS "doc_ID", pos AS sent_id, 'sys' AS system, 'talk' AS dataset, part AS split, CASE part WHEN 'test' THEN 'KB' ELSE 'original' END AS setting, 'sent' AS level, false AS raw
    FROM (SELECT *, replace(text, '. ', '."' || chr(10) || ' ') AS t, row_number() OVER (PARTITION BY part, doc_id % 16 ORDER BY doc_id, sent_id) - 1 AS pos
          FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM v_pair_null))"""))
def import_legacy(spark, sf):
    """Two older corpora below one folder, of other column orders and label names, with quotes and line ends in cells and no row keys."""
    base = fresh_path(spark, "legacy")
    table = fx.pairs_null(spark, sf).select("doc_id", "sent_id", "label", "adv_text", F.replace("text", F.lit(". "), F.lit('."\n ')).alias("text"),
                                            (F.col("doc_id") % 16).alias("bucket"), (F.col("doc_id") % 3 == 0).alias("test"))
    null = lambda c: F.coalesce(c, F.lit("NaN"))
    shapes = {True: ("talk_test_obfuscated_KB_sentences.csv", [null("text").alias("Text"), F.col("label").alias("Label"), F.col("doc_id").alias("doc_ID"), null("adv_text").alias("AdvText")]),
              False: ("talk_train_original_sentences.csv", [F.col("doc_id").alias("doc_ID"), F.col("label").alias("Class"), null("adv_text").alias("AdvText"), null("text").alias("Text")])}
    for test, (name, columns) in shapes.items():
        rows = table.where(F.col("test") == test).repartition(16, "bucket").sortWithinPartitions("bucket", "doc_id", "sent_id")
        corpus.write_csv(rows.select(*columns, "bucket"), f"{base}/{name}", by=["bucket"])
    return corpus.import_legacy(spark, base, "sys")


_LAYOUT_SQL = """SELECT doc_id, text, label, lang AS dataset, split, source AS system,
    CASE WHEN doc_id % 2 = 0 THEN 'KB' ELSE 'original' END AS setting, 'doc' AS level FROM v_class"""


def _laid_out(spark, sf):
    return fx.classified(spark, sf).select(
        "doc_id", "text", "label", F.col("lang").alias("dataset"), "split", F.col("source").alias("system"),
        F.when(F.col("doc_id") % 2 == 0, "KB").otherwise("original").alias("setting"), F.lit("doc").alias("level"))


@query("corpus_layout", using("v_class", """SELECT dataset, split, system, setting, level, count(*) AS rows, min(doc_id) AS first_doc
    FROM laid WHERE split = 'test' AND setting = 'KB' GROUP BY ALL""", laid=_LAYOUT_SQL))
def corpus_layout(spark, sf):
    """Only the folders of the wanted split and setting are opened."""
    path = fresh_path(spark, "layout")
    table = _laid_out(spark, sf)
    corpus.write_corpus(table, path)
    wanted = corpus.read_layout(spark, path, table.schema, split="test", setting="KB")
    return wanted.groupBy(*corpus.LAYOUT).agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_doc"))


@query("legacy_names", using("v_class", """
    SELECT doc_id, lang AS dataset, split, CASE WHEN doc_id % 3 = 0 THEN 'original' ELSE source END AS setting,
           CASE WHEN doc_id % 2 = 0 THEN 'sent' ELSE 'doc' END AS level, doc_id % 7 = 0 AS raw FROM v_class"""))
def legacy_names(spark, sf):
    name = F.concat(
        F.lit("some/where/"), "lang", F.lit("_"), "split", F.lit("_"),
        F.when(F.col("doc_id") % 3 == 0, "original").otherwise(F.concat(F.lit("obfuscated_"), "source")),
        F.when(F.col("doc_id") % 2 == 0, "_sentences").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "_raw").otherwise(""),
        F.lit(".csv"))
    return fx.classified(spark, sf).select("doc_id", *corpus.legacy_name(name))


@query("write_corpus", using("v_class", "SELECT * FROM laid", laid=_LAYOUT_SQL))
def write_corpus(spark, sf):
    """Written twice: the second write replaces the folders it fills and adds no rows."""
    path = fresh_path(spark, "written")
    table = _laid_out(spark, sf)
    corpus.write_corpus(table, path)
    corpus.write_corpus(table.where("split = 'test'"), path)
    return corpus.read_layout(spark, path, table.schema)


@query("snapshot_raw", using("v_raw", f"SELECT doc_id, sent_id, system, setting, {s_markup('raw_text')} AS clean_text FROM v_raw"))
def snapshot_raw(spark, sf):
    """Cleaned twice from the same raw table; the second run does not clean what is clean."""
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")

    def step(table):
        return table.select("doc_id", "sent_id", "system", "setting", tx.strip_markup(F.col("raw_text")).alias("clean_text"))

    corpus.snapshot_raw(spark, raw, clean, step, fx.raw_generations(spark, sf))
    return corpus.snapshot_raw(spark, raw, clean, step)


# result tables -------------------------------------------------------------------------------

_KEYS = ["model", "dataset", "temperature"]
_CELLS = [("SVM", "accuracy"), ("SVM", "f1")]
_BOTH = """SELECT * FROM v_results UNION ALL
    SELECT model, dataset, temperature, classifier, 'f1', value / 2, version FROM v_results WHERE dataset <> 'fr'"""


def _both(spark, sf):
    table = fx.results(spark, sf)
    half = table.where("dataset <> 'fr'").withColumn("metric", F.lit("f1")).withColumn("value", F.col("value") / 2)
    return results.concat_results(table, half)


@query("pivot_results", using("v_results", """
    SELECT model, dataset, temperature, round(max(value) FILTER (metric = 'accuracy'), 6) AS "SVM_accuracy",
           round(max(value) FILTER (metric = 'f1'), 6) AS "SVM_f1" FROM long GROUP BY 1, 2, 3""", long=_BOTH))
def pivot_results(spark, sf):
    wide = results.pivot_results(_both(spark, sf), _KEYS, _CELLS)
    return wide.select(*_KEYS, F.round("SVM_accuracy", 6).alias("SVM_accuracy"), F.round("SVM_f1", 6).alias("SVM_f1"))


@query("read_two_level_results", using("v_results", """
    SELECT model, dataset, temperature, classifier, metric, round(value, 6) AS value FROM long""", long=_BOTH))
def read_two_level_results(spark, sf):
    path = fresh_path(spark, "two-level")
    two_level.write_two_level(results.pivot_results(_both(spark, sf), _KEYS, _CELLS), path, _KEYS, _CELLS)
    return two_level.read_two_level(spark, path).withColumn("value", F.round("value", 6))


# predictions ---------------------------------------------------------------------------------

@query("write_predictions", using("v_pred", "SELECT doc_id AS row_id, yhat AS pred FROM v_pred"))
def write_predictions(spark, sf):
    path = fresh_path(spark, "predictions")
    predictions.write_predictions(fx.predicted(spark, sf), path, "doc_id", "yhat")
    return predictions.read_predictions(spark, path)


@query("prediction_objects", using("v_pred", """
    SELECT doc_id // 1000 AS part, '{' || string_agg('"' || doc_id || '":' || yhat, ',' ORDER BY doc_id) || '}' AS json
    FROM v_pred GROUP BY 1"""))
def prediction_objects(spark, sf):
    return predictions.prediction_objects(fx.predicted(spark, sf), "doc_id", "yhat")


@query("attach_ids", using("v_pred", "SELECT 'S' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS \"ID\", yhat AS pred, doc_id AS row_id FROM v_pred"))
def attach_ids(spark, sf):
    """The identifier file has padded headings and values, as exported metadata does."""
    path = fresh_path(spark, "ids")
    name = F.concat(F.lit("S"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("   "))
    padded = fx.table(spark, sf, "documents").select(
        name.alias("ID   "), F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias(" row "))
    (padded.write.options(header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    ids = predictions.read_id_file(spark, path).select("ID", F.col("row").cast("long").alias("row_id"))
    guessed = fx.predicted(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("yhat").alias("pred"))
    return predictions.attach_ids(guessed, ids, ["row_id"]).select("ID", "pred", "row_id")


# run configurations --------------------------------------------------------------------------

_CLASSIFIERS = ["SVM", "SVM_sent", "LR"]


@query("run_grid", using("", """
    SELECT dataset, source AS system, CASE WHEN long_docs % 2 = 0 THEN 'runs/' || source END AS project_dir, temperature, classifier,
           CASE WHEN long_docs % 3 = 0 THEN 'doc' ELSE 'sent' END AS level, long_docs % 3 = 0 AS by_document,
           NOT (long_docs % 3 = 0 AND classifier = 'SVM_sent') AS runnable
    FROM (SELECT source, count(*) FILTER (n_chars > 500) AS long_docs, unnest(['None', CAST(count(*) AS VARCHAR)]) AS temperature
          FROM documents GROUP BY 1) s
    JOIN (SELECT DISTINCT source AS s2, lang AS dataset FROM documents) d ON s.source = d.s2
    CROSS JOIN (SELECT unnest(['SVM', 'SVM_sent', 'LR']) AS classifier) c"""))
def run_grid(spark, sf):
    """One configuration text per source, built from its documents, then unfolded."""
    long_docs = F.col("long_docs")
    systems = fx.table(spark, sf, "documents").groupBy("source").agg(
        F.count_if(F.col("n_chars") > 500).alias("long_docs"), F.count("*").alias("n"),
        F.array_sort(F.collect_set("lang")).alias("datasets"))   # as many entries as there are languages
    body = F.struct(
        F.when(long_docs % 2 == 0, F.concat(F.lit("runs/"), "source")).otherwise("None").alias("project_dir"),
        F.array(F.lit("None"), F.col("n").cast("string")).alias("temperatures"),
        F.when(long_docs % 3 == 0, "doc").otherwise("sent").alias("level"), (long_docs % 3 == 0).alias("by_document"))
    configs = systems.select("datasets", F.to_json(F.create_map("source", body)).alias("config"))
    return runs.run_grid(configs, "config", "datasets", _CLASSIFIERS)


@query("merge_systems", """
    SELECT source, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'de') THEN 'de' ELSE 'any' END AS level
    FROM documents GROUP BY 1""")
def merge_systems(spark, sf):
    """Two configuration maps per source; where both name it, the second one wins."""
    docs = fx.table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("german"))

    def config(name, level):
        return F.to_json(F.create_map(name, F.struct(F.lit(level).alias("level"))))

    base, extra = config(F.col("source"), "any"), config(
        F.when(F.col("german") > 0, F.col("source")).otherwise("unused"), "de")
    merged = docs.select("source", F.explode(runs.merge_systems(runs.parse_systems(base), runs.parse_systems(extra))).alias("system", "s"))
    return merged.where(F.col("system") == F.col("source")).select("source", F.col("s.level").alias("level"))


@query("knob_from_map", "SELECT event_id, '{k: ' || json_extract_string(props, '$.k') || '}' AS knob FROM events")
def knob_from_map(spark, sf):
    settings = F.from_json("props", T.MapType(T.StringType(), T.StringType()))
    return fx.table(spark, sf, "events").select("event_id", runs.knob_from_map(settings).alias("knob"))
