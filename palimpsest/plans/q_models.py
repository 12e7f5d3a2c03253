"""Queries: classifiers, adversaries, generation, the whole evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import plugins
from palimpsest.functions import text as tx
from palimpsest.operators.skew import by_shuffle
from palimpsest.plans import fixtures as fx
from palimpsest.plans import models as md
from palimpsest.plans import text_models as tm
from palimpsest.plans.catalog import ORACLES, query, s_tokens, s_words, using
from palimpsest.plans.forest import split_counts
from palimpsest.plans.kernel import fit_kernel, predict_kernel
from palimpsest.plans.linear import fit_linear, gradient
from palimpsest.plans.q_cleaning import rewrite_sql
from palimpsest.plans.q_metrics import RATES, rounded
from palimpsest.plans.quality import DEFAULT_METRICS
from palimpsest.plans.systems import evaluate_systems
from palimpsest.workspace import fresh_path


def _split(spark, sf, name):
    docs = fx.classified(spark, sf).where(F.col("split") == name)
    return docs.select("doc_id", "text", "label")


def _predictions(spark, sf, classifier, feature="TFIDF"):
    models = tm.fit_many(_split(spark, sf, "train"), [classifier], feature)
    return tm.predict_many(models, _split(spark, sf, "test")).select("doc_id", "label", "pred")


@query("svm_text_classifier")
def svm_text_classifier(spark, sf):
    return _predictions(spark, sf, "SVM")


@query("svm_text_classifier_bow")
def svm_text_classifier_bow(spark, sf):
    return _predictions(spark, sf, "SVM", "BOW")


@query("forest_text_classifier")
def forest_text_classifier(spark, sf):
    return _predictions(spark, sf, "RF")


@query("logistic_text_classifier")
def logistic_text_classifier(spark, sf):
    return _predictions(spark, sf, "LR")


@query("kernel_text_classifier")
def kernel_text_classifier(spark, sf):
    model = fit_kernel(_split(spark, sf, "train"))
    return predict_kernel(model, _split(spark, sf, "test")).select("doc_id", "label", "pred")


_TRAIN_SQL = f"SELECT doc_id, label, unnest({s_tokens('text')}) AS term FROM v_class WHERE split = 'train'"


@query("linear_optimum", using("v_class", """
    SELECT feature, classifier, (SELECT count(*) FROM v_class WHERE split = 'train') AS rows, (SELECT count(DISTINCT term) FROM terms) AS terms,
           0.0::DOUBLE AS gap FROM (VALUES ('TFIDF'), ('BOW')) a(feature), (VALUES ('SVM'), ('LR')) b(classifier)""", terms=_TRAIN_SQL))
def linear_optimum(spark, sf):
    """All terms have weights, and the weights leave no duality gap: they are those of the optimum."""
    rows = []
    for feature in ("TFIDF", "BOW"):
        data = tm.training_blocks(_split(spark, sf, "train"), feature)
        fit = fit_linear(data, tm.problems_of(data, ["SVM", "LR"], feature), tolerance=1e-10)
        terms, n = data.terms.count(), data.sizes[tm.ALL][0]
        rows += [(feature, name, n, terms, round(abs(fit.gaps[tm.ALL, loss]), 9)) for name, loss in tm.LOSSES.items()]
    return spark.createDataFrame(rows, "feature string, classifier string, rows long, terms long, gap double")


@query("logistic_gradient", using("v_class", "SELECT (SELECT count(*) FROM v_class WHERE split = 'train') AS rows, 0.0::DOUBLE AS norm"))
def logistic_gradient(spark, sf):
    """The length of the gradient at the fitted weights, by joins and sums over all terms of all rows."""
    data = tm.training_blocks(_split(spark, sf, "train"))
    problems = tm.problems_of(data, ["LR"], "TFIDF")
    slope = gradient(data, fit_linear(data, problems, tolerance=1e-14), problems)
    return slope.select(F.lit(data.sizes[tm.ALL][0]).cast("long").alias("rows"), F.abs(F.round("norm", 6)).alias("norm"))


_ROOT_SQL = using("v_class", """
    SELECT t.term, count(*) FILTER (label = 0) AS a0, count(*) FILTER (label = 1) AS a1, any_value(n0) AS n0, any_value(n1) AS n1
    FROM (SELECT DISTINCT doc_id, label, term FROM terms) t,
         (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM v_class WHERE split = 'train') GROUP BY t.term""", terms=_TRAIN_SQL)


@query("term_splits", _ROOT_SQL)
def term_splits(spark, sf):
    """What every split at a root has to choose from: class counts of the texts with each term, from the blocks."""
    data = tm.training_blocks(_split(spark, sf, "train"))
    return split_counts(data).join(by_shuffle(data.terms.select("term_id", "term")), "term_id").select("term", *[F.col(c).cast("long").alias(c) for c in ("a0", "a1", "n0", "n1")])


@query("save_load_model")
def save_load_model(spark, sf):
    path = fresh_path(spark, "model")
    tm.fit_many(_split(spark, sf, "train"), ["LR", "RF"]).save(path)
    return tm.predict_many(tm.TextModels.load(spark, path), _split(spark, sf, "test")).select("doc_id", "label", "classifier", "pred")


@query("formality")
def formality(spark, sf):
    models = tm.fit_many(_split(spark, sf, "train"), ["LR"])
    pairs = fx.pairs(spark, sf).select("doc_id", "sent_id", "label", F.col("adv_text").alias("text"))
    return tm.predict_many(models, pairs).select("doc_id", "sent_id", "label", F.col("score").alias("formality"))


def _knobs(docs):
    """Each document under the built-in rewriter with two knobs; rewritten once, and not where only the knobs are read."""
    knobs = F.array(*[F.struct(F.lit("rewriter").alias("system"), F.lit(t).alias("temperature")) for t in ("t0", "t1")])
    runs = docs.withColumn("_rewritten", tx.disfluency_rewrite(F.col("text"))).select("*", F.inline(knobs))
    adv_text = F.when(F.col("temperature") == "t0", F.col("_rewritten")).otherwise(F.lower("_rewritten"))
    return runs.withColumn("adv_text", adv_text).drop("_rewritten")


def _static(spark, sf, classifiers, learner=None):
    test = _split(spark, sf, "test")
    sides = test.select("doc_id", "label", "text", F.lit("Original").alias("model"), F.lit("None").alias("temperature")).unionByName(
        _knobs(test).select("doc_id", "label", F.col("adv_text").alias("text"), F.col("system").alias("model"), "temperature"))
    return md.static_adversary(_split(spark, sf, "train"), sides, ["model", "temperature"], classifiers, learner=learner)


def _adaptive(spark, sf, classifiers, learner=None):
    learnt, scored = (_knobs(docs).select("doc_id", "label", F.col("adv_text").alias("text"), "system", "temperature")
                      for docs in (_split(spark, sf, "train"), _split(spark, sf, "test")))
    return md.adaptive_adversary(_split(spark, sf, "train"), learnt, scored, ["system", "temperature"], classifiers,
                                 learner=learner, knob=["system", "temperature"])


@query("static_adversary")
def static_adversary(spark, sf):
    return _static(spark, sf, list(md.CLASSIFIERS))


@query("adaptive_adversary")
def adaptive_adversary(spark, sf):
    return _adaptive(spark, sf, list(md.CLASSIFIERS))


# The adversaries with a rule in place of the fit, so that SQL can say all their rows: class 1 is what has more tokens than the mean
# training text of the set.

def longer_than_the_mean(train, classifiers):
    tokens = F.size(tx.tokens(F.coalesce("text", F.lit(""))))
    means = train.select("sets", tokens.alias("k")).select(F.explode("sets").alias("set"), "k").groupBy("set").agg(F.sum("k").alias("_sum"), F.count("*").alias("_n"))

    def judge(df):
        asked = df.select("*", tokens.alias("_k")).select("*", F.explode("sets").alias("set")).join(F.broadcast(means), "set")   # a row a set
        named = asked.select("*", (F.col("_k") * F.col("_n") > F.col("_sum")).cast("int").alias("pred"), F.explode(F.array(*map(F.lit, classifiers))).alias("classifier"))
        return named.drop("text", "sets", "_k", "_sum", "_n")
    return judge


_COUNT = f"len({s_tokens("coalesce(text, '')")})"
_KNOB_TABLES = {
    "rewritten": rewrite_sql("v_class", "doc_id, label, split"),
    "knobs": """SELECT doc_id, label, split, 'rewriter' AS system, 't0' AS temperature, rewritten AS text FROM rewritten
        UNION ALL SELECT doc_id, label, split, 'rewriter', 't1', lower(rewritten) FROM rewritten""",
}


def _rates_sql(keys: str, classifier: str) -> str:
    """Long result rows from a table ``judged`` of keys, y and yhat."""
    cell = lambda y, p: f"sum(CASE WHEN y = {y} AND yhat = {p} THEN 1.0E0 ELSE 0 END)"
    cells = f"SELECT {keys}, {cell(1, 1)} AS tp, {cell(0, 0)} AS tn, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn FROM judged GROUP BY {keys}"
    each = [f"SELECT {keys}, '{classifier}' AS classifier, '{shown}' AS metric, round(coalesce(CASE WHEN isfinite({RATES[name]}) THEN {RATES[name]} END, 0), 6) AS value FROM cells"
            for name, shown in md._METRIC_NAMES.items()]
    return f"SELECT * FROM (WITH cells AS ({cells}) " + " UNION ALL ".join(each) + ")"


@query("static_adversary_rule", using("v_class", _rates_sql("model, temperature", "rule"), recursive=True, **_KNOB_TABLES,
    mean="SELECT avg(k) AS k FROM (SELECT " + _COUNT + " AS k FROM v_class WHERE split = 'train')",
    sides="SELECT 'Original' AS model, 'None' AS temperature, label, text FROM v_class WHERE split = 'test' UNION ALL SELECT system, temperature, label, text FROM knobs WHERE split = 'test'",
    judged="SELECT model, temperature, label AS y, CAST(" + _COUNT + " > mean.k AS INT) AS yhat FROM sides, mean"))
def static_adversary_rule(spark, sf):
    return rounded(_static(spark, sf, ["rule"], longer_than_the_mean), "value")


@query("adaptive_adversary_rule", using("v_class", _rates_sql("system, temperature", "ADA_rule"), recursive=True, **_KNOB_TABLES,
    learnt="""SELECT t AS temperature, text FROM v_class, (VALUES ('t0'), ('t1')) k(t) WHERE split = 'train' AND text IS NOT NULL AND label IS NOT NULL AND len(string_split(text, ' ')) > 3
        UNION ALL SELECT temperature, text FROM knobs WHERE split = 'train' AND text IS NOT NULL AND label IS NOT NULL""",
    mean="SELECT temperature, avg(k) AS k FROM (SELECT temperature, " + _COUNT + " AS k FROM learnt) GROUP BY temperature",
    judged="SELECT system, s.temperature, label AS y, CAST(" + _COUNT + " > mean.k AS INT) AS yhat FROM knobs s JOIN mean ON mean.temperature = s.temperature WHERE split = 'test'"))
def adaptive_adversary_rule(spark, sf):
    return rounded(_adaptive(spark, sf, ["rule"], longer_than_the_mean), "value")


def drop_fillers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A stand-in for a model: one compiled pattern per worker, one pass per batch."""
    pattern = re.compile(r"(?i)\b(the|an?) ")
    for texts in parts:
        yield texts.str.replace(pattern, "", regex=True)


@query("batch_generate_whole", using("v_pair", r"""
    SELECT doc_id, sent_id, text, label,
           regexp_replace(text, '(^|[^\p{L}\p{N}_])((the|an?) )+', '\1', 'gi') AS adv_text FROM v_pair"""))
def batch_generate_whole(spark, sf):
    return batch_generate(spark, sf)


@query("batch_generate", ORACLES["batch_generate_whole"])
def batch_generate(spark, sf):
    pairs = fx.pairs(spark, sf).select("doc_id", "sent_id", "label", "text")
    return md.batch_generate(pairs, "text", "adv_text", drop_fillers).select("doc_id", "sent_id", "text", "label", "adv_text")


@query("training_pairs", using("v_pair_null", f"""
    SELECT doc_id, sent_id, array_to_string({s_words('text')}[1:100], ' ') AS source,
           array_to_string({s_words("coalesce(adv_text, '')")}[1:100], ' ') AS target, CAST(label AS DOUBLE) AS label
    FROM v_pair_null WHERE text IS NOT NULL"""))
def training_pairs(spark, sf):
    return md.training_pairs(fx.pairs_null(spark, sf), ["doc_id", "sent_id"], "text", "adv_text", "label")


def split_in_python(text: str):
    """A stand-in for a caller's processor."""
    for at, piece in enumerate(re.split(r"(?<=[.!?])[ \t\n\r]+", text)):
        if piece:
            yield at, piece


@query("process_texts", using("v_sent", "SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, text FROM v_sent"))
def process_texts(spark, sf):
    docs = fx.labelled_documents(spark, sf).select("doc_id", F.col("text").alias("body"))
    schema = T.StructType([T.StructField("sent_id", T.LongType()), T.StructField("text", T.StringType())])
    return plugins.process_texts(docs, ["doc_id"], "body", split_in_python, schema)


def share_of_capitals(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A stand-in for a scoring model."""
    for texts in parts:
        yield texts.str.count("[A-Z]") / texts.str.len().clip(lower=1)


@query("score_texts", r"""
    SELECT doc_id, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(len(text), 1)::DOUBLE, 6) AS score FROM documents""")
def score_texts(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return plugins.score_texts(docs, "text", share_of_capitals).select("doc_id", F.round("score", 6).alias("score"))


def _sentences(spark, sf, wanted):
    return fx.sentences(spark, sf).where((F.col("doc_id") % 5 == 0) == F.lit(wanted == "test"))


def _sentence_knobs(sentences):
    return _knobs(sentences).withColumnRenamed("system", "model")


def _evaluation(spark, sf, level):
    train, test = _sentences(spark, sf, "train"), _sentences(spark, sf, "test")
    return evaluate_systems(train, test, _sentence_knobs(train), _sentence_knobs(test), list(md.CLASSIFIERS),
                            DEFAULT_METRICS, "documents", level)


@query("evaluate_systems")
def evaluate_by_sentence(spark, sf):
    return _evaluation(spark, sf, "sent")


@query("evaluate_systems_doc")
def evaluate_by_document(spark, sf):
    return _evaluation(spark, sf, "doc")
