"""Queries: detection metrics and summaries of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import similarity as sim
from palimpsest.functions import text as tx
from palimpsest.operators import metrics as mt
from palimpsest.plans import fixtures as fx
from palimpsest.plans.catalog import WS, query, s_words, using


def rounded(df, *columns, places=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


RATES = {
    "accuracy": "(tp + tn) / (tp + tn + fp + fn)", "recall": "tp / (tp + fn)", "recall_0": "tn / (tn + fp)",
    "precision": "tp / (tp + fp)", "precision_0": "tn / (tn + fn)", "f1": "2 * tp / (2 * tp + fp + fn)",
    "f1_0": "2 * tn / (2 * tn + fp + fn)",
    "mcc": "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))",
}
_CELLS = """SELECT {by} sum(CASE WHEN y = 1 AND yhat = 1 THEN 1.0E0 ELSE 0 END) AS tp,
    sum(CASE WHEN y = 0 AND yhat = 0 THEN 1.0E0 ELSE 0 END) AS tn,
    sum(CASE WHEN y = 0 AND yhat = 1 THEN 1.0E0 ELSE 0 END) AS fp,
    sum(CASE WHEN y = 1 AND yhat = 0 THEN 1.0E0 ELSE 0 END) AS fn FROM v_pred {group}"""


def _rate_sql(by: str, names) -> str:
    cells = _CELLS.format(by=f"{by}, " if by else "", group=f"GROUP BY {by}" if by else "")
    safe = [f"round(coalesce(CASE WHEN isfinite({RATES[n]}) THEN {RATES[n]} END, 0), 6) AS {n}" for n in names]
    return using("v_pred", f"SELECT {by + ', ' if by else ''}{', '.join(safe)} FROM ({cells})")


@query("binary_metrics", _rate_sql("lang", RATES))
def binary_metrics(spark, sf):
    return rounded(mt.binary_metrics(fx.predicted(spark, sf), by=["lang"]), *RATES)


@query("mcc", _rate_sql("", ["mcc"]))
def mcc(spark, sf):
    return rounded(mt.mcc(fx.predicted(spark, sf)), "mcc")


_THREE = """SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS y,
    CASE WHEN n_chars > 2000 THEN 'other' WHEN n_chars > 700 THEN 'en' ELSE 'de' END AS yhat FROM documents"""
_PER_CLASS = """SELECT class, support, hit, coalesce(hit / nullif(guessed, 0), 0.0E0) AS precision,
    coalesce(hit / nullif(support, 0), 0.0E0) AS recall, coalesce(2.0E0 * hit / nullif(guessed + support, 0), 0.0E0) AS f1
    FROM (SELECT class, (SELECT count(*) FROM three WHERE y = class) AS support,
                 (SELECT count(*) FROM three WHERE yhat = class) AS guessed,
                 (SELECT count(*) FROM three WHERE y = class AND yhat = class) * 1.0E0 AS hit
          FROM (SELECT y AS class FROM three UNION SELECT yhat FROM three))"""


def _three(spark, sf):
    docs = fx.table(spark, sf, "documents")
    truth = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other")
    guess = F.when(F.col("n_chars") > 2000, "other").when(F.col("n_chars") > 700, "en").otherwise("de")
    return docs.select("doc_id", truth.alias("y"), guess.alias("yhat"))


@query("weighted_metrics", using("", """SELECT round(sum(hit) / sum(support), 6) AS accuracy,
    round(sum(recall * support) / sum(support), 6) AS recall, round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(f1 * support) / sum(support), 6) AS f1 FROM classes""", three=_THREE, classes=_PER_CLASS))
def weighted_metrics(spark, sf):
    return rounded(mt.weighted_metrics(_three(spark, sf)), "accuracy", "recall", "precision", "f1")


@query("classification_report", using("", """
    SELECT class AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM classes
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
        round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM classes
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
        CAST(sum(support) AS BIGINT) FROM classes
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM classes""", three=_THREE, classes=_PER_CLASS))
def classification_report(spark, sf):
    return rounded(mt.classification_report(_three(spark, sf)), "precision", "recall", "f1")


_LENGTHS = f"""SELECT doc_id, sent_id, label, CAST(len({s_words('adv_text')}) AS DOUBLE) AS words,
    CASE WHEN len(adv_text) % 7 = 0 THEN 'NaN'::DOUBLE ELSE CAST(len(adv_text) AS DOUBLE) END AS chars FROM v_pair"""


def _scores(spark, sf):
    """Two scores per pair; one has NaN cells."""
    adv = F.col("adv_text")
    return fx.pairs(spark, sf).select(
        "doc_id", "sent_id", "label", F.size(tx.words(adv)).cast("double").alias("words"),
        F.when(F.length(adv) % 7 == 0, F.lit(float("nan"))).otherwise(F.length(adv).cast("double")).alias("chars"))


_SUMMARY = ", ".join(f"round(avg({c}) FILTER (NOT isnan({c})), 6) AS {c}_mean, "
                     f"round(stddev_pop({c}) FILTER (NOT isnan({c})), 6) AS {c}_std" for c in ("words", "chars"))


@query("metric_summary", using("v_pair", f"SELECT {_SUMMARY} FROM scores", scores=_LENGTHS))
def metric_summary(spark, sf):
    out = mt.metric_summary(_scores(spark, sf), ["words", "chars"])
    return rounded(out, *out.columns)


@query("metric_by_class", using("v_pair", " UNION ALL ".join(f"""
    SELECT 'answers' AS model, CASE grouping(label) WHEN 1 THEN 'ALL' ELSE CASE label WHEN 0 THEN 'CC' ELSE 'AD' END END AS label_group,
      '{c}' AS metric, round(avg({c}) FILTER (NOT isnan({c})), 6) AS value, round(stddev_pop({c}) FILTER (NOT isnan({c})), 6) AS std
    FROM scores GROUP BY GROUPING SETS ((), (label))""" for c in ("words", "chars")), scores=_LENGTHS))
def metric_by_class(spark, sf):
    scores = _scores(spark, sf).withColumn("model", F.lit("answers"))
    return rounded(mt.metric_by_class(scores, ["words", "chars"], ["model"]), "value", "std")


@query("two_level_mean", using("v_pair", """
    SELECT round(avg(m), 6) AS chars_mean, count(m) AS groups FROM (
      SELECT doc_id, avg(chars) FILTER (NOT isnan(chars)) AS m FROM scores GROUP BY 1)""", scores=_LENGTHS))
def two_level_mean(spark, sf):
    return rounded(mt.two_level_mean(_scores(spark, sf), "chars", "doc_id"), "chars_mean")


# word edit operations in SQL: one row of the table of least costs per step --------------------

EDIT_BASE = 100000


def edit_tables(source: str, keys: str, ref: str = "text", hyp: str = "adv_text") -> dict[str, str]:
    """Tables ``ops`` (recursive) and ``edits``: least (cost, substitutions) packed in one number."""
    def words(x: str) -> str:
        squeezed = f"regexp_replace({x}, '{WS}{WS}+', ' ', 'g')"
        trimmed = f"regexp_replace({squeezed}, '^{WS}+|{WS}+$', '', 'g')"
        return f"list_filter(string_split({trimmed}, ' '), lambda w: w <> '')"

    joined = " AND ".join(f"c.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    prefixed = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return {
        "split_words": f"SELECT {keys}, {words(ref)} AS r, {words(hyp)} AS h FROM {source}",
        "ops": f"""
            SELECT {keys}, 0 AS i, j, j * {EDIT_BASE}::BIGINT AS v
            FROM (SELECT {keys}, unnest(generate_series(0, len(h))) AS j FROM split_words)
            UNION ALL
            SELECT {keys}, i, j, min(x - j * {EDIT_BASE}) OVER (PARTITION BY {keys} ORDER BY j) + j * {EDIT_BASE} AS v
            FROM (SELECT {prefixed}, c.i + 1 AS i, c.j,
                         least(c.v + {EDIT_BASE}, coalesce(
                           lag(c.v) OVER (PARTITION BY {prefixed} ORDER BY c.j)
                             + CASE WHEN s.r[c.i + 1] = s.h[c.j] THEN 0 ELSE {EDIT_BASE + 1} END,
                           c.v + {EDIT_BASE})) AS x
                  FROM ops c JOIN split_words s ON {joined} WHERE c.i < len(s.r))""",
        "edits": f"""
            SELECT {keys}, cost, subs AS substitutions, (cost - subs + m - n) // 2 AS insertions,
                   (cost - subs - m + n) // 2 AS deletions, n AS ref_words, m AS hyp_words
            FROM (SELECT {prefixed}, c.v // {EDIT_BASE} AS cost, c.v % {EDIT_BASE} AS subs, len(s.r) AS n, len(s.h) AS m
                  FROM ops c JOIN split_words s ON {joined} WHERE c.i = len(s.r) AND c.j = len(s.h))""",
    }


_EDITS = edit_tables("v_pair", "doc_id, sent_id")


@query("word_edit_ops", using("v_pair", "SELECT doc_id, sent_id, " + ", ".join(
    f"CAST({c} AS INT) AS {c}" for c in ("cost", "substitutions", "insertions", "deletions", "ref_words", "hyp_words"))
    + " FROM edits", recursive=True, **_EDITS))
def word_edit_ops(spark, sf):
    ops = sim.word_edit_ops(tx.edit_words(F.col("text")), tx.edit_words(F.col("adv_text")))
    return fx.pairs(spark, sf).select("doc_id", "sent_id", ops.alias("ops")).select("doc_id", "sent_id", "ops.*")


@query("edit_rates", using("v_pair", """
    SELECT label, round(avg(substitutions / nullif(ref_words, 0)), 6) AS SUB, round(avg(insertions / nullif(ref_words, 0)), 6) AS ADD,
           round(avg(deletions / nullif(ref_words, 0)), 6) AS DEL
    FROM (SELECT CAST(doc_id % 2 AS INT) AS label, CAST(ref_words AS DOUBLE) AS ref_words, substitutions, insertions, deletions
          FROM edits) GROUP BY 1""", recursive=True, **_EDITS))
def edit_rates(spark, sf):
    ops = sim.word_edit_ops(tx.edit_words(F.col("text")), tx.edit_words(F.col("adv_text")))
    return rounded(mt.edit_rates(fx.pairs(spark, sf).select("label", ops.alias("ops")), "ops", ["label"]), "SUB", "ADD", "DEL")


@query("argmax_label", using("v_logits", """
    SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS pred FROM v_logits"""))
def argmax_label(spark, sf):
    return fx.logits(spark, sf).select("vec_id", sim.argmax(F.col("logits")).alias("pred"))


@query("corpus_profile", using("v_class", """
    SELECT lang, split, label, count(*) AS rows, CAST(ceil(count(*) / 32.0E0) AS BIGINT) AS batches
    FROM v_class GROUP BY ROLLUP (lang, split, label)"""))
def corpus_profile(spark, sf):
    return mt.corpus_profile(fx.classified(spark, sf), ["lang", "split", "label"])
