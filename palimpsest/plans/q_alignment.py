"""Queries: joins, documents, row numbers, windows, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions.lexicon import STOP_WORDS
from palimpsest.operators import documents as docs
from palimpsest.operators import numbering as num
from palimpsest.operators import pairing, results, training_log
from palimpsest.plans import fixtures as fx
from palimpsest.plans.catalog import NOT_WS, WS, query, s_words, using
from palimpsest.schema import RESULT_KEYS

KEYS = ["doc_id", "sent_id"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


# joins ---------------------------------------------------------------------------------------

@query("attach_generated", using("v_pair", f"""
    SELECT doc_id, sent_id, text, 'So: ' || text AS adv_text, label FROM v_pair WHERE len({s_words('text')}) >= 3"""))
def attach_generated(spark, sf):
    source = fx.pairs(spark, sf).select(*KEYS, "text", "label").where(tx.has_min_words(F.col("text"), 3))
    generated = source.select(*KEYS, F.concat(F.lit("So: "), "text").alias("adv_text"))
    return pairing.attach_generated(source, generated, KEYS).select(*KEYS, "text", "adv_text", "label")


def _mixed(spark, sf):
    """Pairs whose documents hold both labels."""
    return fx.pairs(spark, sf).withColumn("label", (F.floor(F.col("sent_id") / 2) % 2).cast("int"))


MIXED = "SELECT doc_id, sent_id, text, adv_text, CAST((sent_id // 2) % 2 AS INT) AS label FROM v_pair"
DOC_TEXTS = "SELECT doc_id, label, string_agg(text, '.' ORDER BY sent_id) AS text FROM mixed GROUP BY 1, 2"


@query("pair_documents", using("v_pair", """
    SELECT o.doc_id, o.label, o.text, r.adv_text FROM originals o
    JOIN (SELECT doc_id, label, string_agg(adv_text, '.' ORDER BY sent_id) AS adv_text FROM mixed GROUP BY 1, 2) r
      ON o.doc_id = r.doc_id AND o.label = r.label""", mixed=MIXED, originals=DOC_TEXTS))
def pair_documents(spark, sf):
    pairs = _mixed(spark, sf)
    keys = ["doc_id", "label"]
    return docs.pair_documents(docs.assemble_docs(pairs, keys, "sent_id", "text"),
                               docs.assemble_docs(pairs, keys, "sent_id", "adv_text"), keys)


@query("pair_documents_positional", using("v_pair", """
    SELECT o.row_id, o.doc_id, o.label, o.text, r.adv_text
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id, label) - 1 AS row_id FROM originals) o
    LEFT JOIN (SELECT adv_text, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM (
        SELECT doc_id, string_agg(adv_text, '.' ORDER BY sent_id) AS adv_text FROM mixed GROUP BY 1)) r
      ON o.row_id = r.row_id""", mixed=MIXED, originals=DOC_TEXTS))
def pair_documents_positional(spark, sf):
    pairs = _mixed(spark, sf)
    originals = docs.assemble_docs(pairs, ["doc_id", "label"], "sent_id", "text")
    rewrites = docs.assemble_docs(pairs, ["doc_id"], "sent_id", "adv_text")
    return docs.pair_documents_by_position(originals, rewrites, ["doc_id", "label"], ["doc_id"], "adv_text")


@query("pair_sides", using("v_pair v_raw", """
    SELECT p.doc_id, p.sent_id, p.text, p.label, r.system, r.setting, r.raw_text AS adv_text
    FROM v_pair p JOIN v_raw r ON p.doc_id = r.doc_id AND p.sent_id = r.sent_id"""))
def pair_sides(spark, sf):
    rewrites = fx.raw_generations(spark, sf).withColumnRenamed("raw_text", "adv_text")
    return pairing.pair_sides(fx.pairs(spark, sf).select(*KEYS, "text", "label"), rewrites, KEYS)


@query("join_predictions", using("v_pred", "SELECT doc_id, y, yhat, CAST(y = yhat AS INT) AS hit FROM v_pred"))
def join_predictions(spark, sf):
    predicted = fx.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("yhat"))
    truth = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return pairing.join_predictions(truth, predicted, ["doc_id"]).withColumn("hit", (F.col("y") == F.col("yhat")).cast("int"))


_CHANGED = """SELECT source AS model, lang AS dataset, concat('t', CAST(doc_id % 3 AS STRING)) AS temperature,
    'SVM' AS classifier, metric, avg(value) AS value, CAST(2 AS BIGINT) AS version
    FROM (SELECT *, 'accuracy' AS metric, CASE WHEN y = 1 THEN 1.0E0 ELSE 0.0E0 END AS value FROM v_pred WHERE lang = 'en'
          UNION ALL SELECT *, 'f1' AS metric, yhat * 1.0E0 AS value FROM v_pred) GROUP BY 1, 2, 3, 5"""
_RESULT_KEYS = ["model", "dataset", "temperature", "classifier", "metric"]


def _changed(spark, sf):
    pred = fx.predicted(spark, sf)
    cells = F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.when(F.col("lang") == "en", F.col("y").cast("double")).alias("value")),
        F.struct(F.lit("f1").alias("metric"), F.col("yhat").cast("double").alias("value")))
    rows = pred.select(F.col("source").alias("model"), F.col("lang").alias("dataset"),
                       F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("temperature"),
                       F.lit("SVM").alias("classifier"), F.inline(cells)).where("value IS NOT NULL")
    return rows.groupBy(*_RESULT_KEYS).agg(F.avg("value").alias("value")).withColumn("version", F.lit(2).cast("long"))


UPSERTED = """SELECT model, dataset, temperature, classifier, metric, round(value, 6) AS value, version FROM (
    SELECT *, row_number() OVER (PARTITION BY model, dataset, temperature, classifier, metric ORDER BY version DESC) AS rn
    FROM (SELECT * FROM v_results UNION ALL SELECT * FROM changed)) WHERE rn = 1"""


@query("upsert_results", using("v_results", UPSERTED, changed=_CHANGED))
def upsert_results(spark, sf):
    merged = results.upsert_results(fx.results(spark, sf), _changed(spark, sf), _RESULT_KEYS)
    return merged.withColumn("value", F.round("value", 6))


@query("remove_stopwords", using("v_sent", rf"""
    SELECT doc_id, sent_id, word, count(*) AS n FROM (
      SELECT doc_id, sent_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM v_sent)
    WHERE word NOT IN ({STOP_SQL}) GROUP BY 1, 2, 3"""))
def remove_stopwords(spark, sf):
    words = fx.sentences(spark, sf).select(*KEYS, F.explode(tx.tokens(F.col("text"))).alias("word"))
    return pairing.remove_stopwords(words, "word").groupBy(*KEYS, "word").agg(F.count("*").alias("n"))


# documents -----------------------------------------------------------------------------------

@query("assemble_docs", using("v_sent", "SELECT doc_id, label, string_agg(text, '.' ORDER BY sent_id) AS text FROM v_sent GROUP BY 1, 2"))
def assemble_docs(spark, sf):
    return docs.assemble_docs(fx.sentences(spark, sf), ["doc_id", "label"], "sent_id", "text", ".")


@query("assemble_docs_joined", using("v_sent", "SELECT doc_id, label, string_agg(text, '' ORDER BY sent_id) AS text FROM v_sent GROUP BY 1, 2"))
def assemble_docs_joined(spark, sf):
    return docs.assemble_docs(fx.sentences(spark, sf), ["doc_id", "label"], "sent_id", "text", "")


@query("assemble_docs_by_doc", using("v_pair_null", """
    SELECT doc_id, string_agg(adv_text, '.' ORDER BY sent_id) AS adv_text FROM v_pair_null GROUP BY 1"""))
def assemble_docs_by_doc(spark, sf):
    return docs.assemble_docs(fx.pairs_null(spark, sf), ["doc_id"], "sent_id", "adv_text", ".")


@query("split_sentences", using("v_sent", "SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, text, label FROM v_sent"))
def split_sentences(spark, sf):
    return fx.sentences(spark, sf)


# numbering and windows -----------------------------------------------------------------------

@query("row_ids", using("v_pair", """
    SELECT doc_id, sent_id, row_number() OVER (ORDER BY doc_id, sent_id) - 1 AS row_id,
           row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS pos FROM v_pair"""))
def row_ids(spark, sf):
    return num.row_ids(fx.pairs(spark, sf).select(*KEYS), ["doc_id"], ["sent_id"])


@query("split_batches", using("v_pair", """
    SELECT doc_id, sent_id, CASE WHEN row < larger * (each + 1) THEN row // (each + 1)
           ELSE larger + (row - larger * (each + 1)) // each END AS batch
    FROM (SELECT doc_id, sent_id, row_number() OVER (ORDER BY doc_id, sent_id) - 1 AS row FROM v_pair)
    CROSS JOIN (SELECT n // k AS each, n % k AS larger FROM (
        SELECT count(*) AS n, CAST(ceil(count(*) / 32.0) AS BIGINT) AS k FROM v_pair))"""))
def split_batches(spark, sf):
    return num.split_batches(fx.pairs(spark, sf).select(*KEYS), KEYS, 32)


@query("head_fraction", using("v_pair", """
    SELECT doc_id, sent_id FROM (SELECT *, row_number() OVER (ORDER BY doc_id, sent_id) AS rn FROM v_pair)
    WHERE rn <= floor((SELECT count(*) FROM v_pair) * 0.3E0)"""))
def head_fraction(spark, sf):
    return num.head_fraction(fx.pairs(spark, sf).select(*KEYS), KEYS, 0.3)


@query("seeded_shuffle", using("v_pair", """
    SELECT doc_id, sent_id, row_number() OVER (ORDER BY md5('42|' || doc_id || '|' || sent_id), doc_id, sent_id) - 1 AS shuffle_pos
    FROM v_pair"""))
def seeded_shuffle(spark, sf):
    return num.seeded_shuffle(fx.pairs(spark, sf).select(*KEYS), KEYS, 42)


@query("early_stopping", using("v_log", """
    SELECT run_id, step, val_loss, least(val_loss, coalesce(prior, val_loss)) AS best_loss,
           step - last_hit AS no_improvement, step - last_hit >= 3 AS stop
    FROM (SELECT *, max(CASE WHEN prior IS NULL OR val_loss < prior THEN step END) OVER (
                 PARTITION BY run_id ORDER BY step) AS last_hit
          FROM (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY step
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM v_log))"""))
def early_stopping(spark, sf):
    return training_log.early_stopping(fx.training_log(spark, sf), patience=3)


@query("best_n_checkpoints", using("v_log", """
    SELECT run_id, step, val_loss, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, step) AS rank FROM v_log) WHERE rank <= 3"""))
def best_n_checkpoints(spark, sf):
    return training_log.best_n_checkpoints(fx.training_log(spark, sf), 3)


# unions --------------------------------------------------------------------------------------

@query("adaptive_training_set", using("v_pair_null", """
    SELECT doc_id, sent_id, text, label, adv_text, 'original' AS side FROM v_pair_null
    WHERE text IS NOT NULL AND len(string_split(text, ' ')) > 3
    UNION ALL SELECT doc_id, sent_id, adv_text, label, NULL, 'rewritten' FROM v_pair_null WHERE adv_text IS NOT NULL"""))
def adaptive_training_set(spark, sf):
    pairs = fx.pairs_null(spark, sf)
    rewrites = pairs.select("label", F.col("adv_text").alias("text"), *KEYS)
    return pairing.adaptive_training_set(pairs, rewrites, "text")


@query("concat_results", using("v_results", """
    SELECT model, dataset, temperature, classifier, metric, round(value, 6) AS value, version FROM (
      SELECT * FROM v_results UNION ALL SELECT * FROM changed)""", changed=_CHANGED))
def concat_results(spark, sf):
    both = results.concat_results(fx.results(spark, sf), _changed(spark, sf))
    return both.withColumn("value", F.round("value", 6))
