"""Queries: filters, projections and cleaning of generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import answers, prompts
from palimpsest.functions import text as tx
from palimpsest.operators import pairing
from palimpsest.plans import fixtures as fx
from palimpsest.plans.catalog import (
    NOT_WS, query, s_after, s_answer, s_balance, s_first_sentence, s_markup, s_words, using,
)

KEYS = ["doc_id", "sent_id"]


@query("drop_null_any", using("v_pair_null", "SELECT * FROM v_pair_null WHERE text IS NOT NULL AND adv_text IS NOT NULL AND label IS NOT NULL"))
def drop_null_any(spark, sf):
    return fx.pairs_null(spark, sf).na.drop("any")


@query("drop_null_text", using("v_pair_null", "SELECT * FROM v_pair_null WHERE text IS NOT NULL"))
def drop_null_text(spark, sf):
    return fx.pairs_null(spark, sf).na.drop(subset=["text"])


@query("fill_null_text", using("v_pair_null", """
    SELECT doc_id, sent_id, coalesce(text, '') AS text, coalesce(adv_text, '') AS adv_text, label FROM v_pair_null"""))
def fill_null_text(spark, sf):
    return fx.pairs_null(spark, sf).na.fill("", subset=["text", "adv_text"])


@query("min_words_ge3", f"SELECT doc_id, text FROM documents WHERE len({s_words('text')}) >= 3")
def min_words_ge3(spark, sf):
    return fx.table(spark, sf, "documents").where(tx.has_min_words(F.col("text"), 3)).select("doc_id", "text")


@query("min_words_gt3", using("v_sent", f"SELECT doc_id, sent_id, text FROM v_sent WHERE len({s_words('text')}) > 3"))
def min_words_gt3(spark, sf):
    return fx.sentences(spark, sf).where(tx.has_min_words(F.col("text"), 4)).select("doc_id", "sent_id", "text")


@query("min_fields_gt3", using("v_sent", "SELECT doc_id, sent_id, text FROM v_sent WHERE len(string_split(text, ' ')) > 3"))
def min_fields_gt3(spark, sf):
    return fx.sentences(spark, sf).where(tx.has_min_fields(F.col("text"))).select("doc_id", "sent_id", "text")


@query("select_side_original", using("v_pair_null", "SELECT doc_id, sent_id, text, label FROM v_pair_null"))
def select_side_original(spark, sf):
    return pairing.select_side(fx.pairs_null(spark, sf), "original", "text", "adv_text")


@query("select_side_rewritten", using("v_pair_null", "SELECT doc_id, sent_id, adv_text AS text, label FROM v_pair_null"))
def select_side_rewritten(spark, sf):
    return pairing.select_side(fx.pairs_null(spark, sf), "rewritten", "text", "adv_text")


@query("strip_markup", using("v_raw", f"""
    SELECT 'raw' AS origin, doc_id, sent_id, system, setting, {s_markup('raw_text')} AS clean_text FROM v_raw
    UNION ALL SELECT 'document', doc_id, 0, '', '', {s_markup('text')} FROM documents"""))
def strip_markup(spark, sf):
    raw = fx.raw_generations(spark, sf).select(
        F.lit("raw").alias("origin"), *KEYS, "system", "setting", tx.strip_markup(F.col("raw_text")).alias("clean_text"))
    docs = fx.table(spark, sf, "documents").select(
        F.lit("document").alias("origin"), "doc_id", F.lit(0).cast("long").alias("sent_id"), F.lit("").alias("system"),
        F.lit("").alias("setting"), tx.strip_markup(F.col("text")).alias("clean_text"))
    return raw.unionByName(docs)


@query("extract_answer", using(
    "v_raw", f"SELECT doc_id, sent_id, system, setting, {s_answer('bare')} AS answer FROM stripped",
    stripped=f"SELECT doc_id, sent_id, system, setting, {s_markup('raw_text')} AS bare FROM v_raw"))
def extract_answer(spark, sf):
    bare = fx.raw_generations(spark, sf).withColumn("bare", tx.strip_markup(F.col("raw_text")))
    return answers.extract_answer(bare, "bare").select(*KEYS, "system", "setting", "answer")


@query("first_sentence", f"SELECT doc_id, {s_first_sentence('text')} AS first_sentence FROM documents")
def first_sentence(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("first_sentence"))


@query("balance_quote", using("v_raw", f"SELECT doc_id, sent_id, system, setting, {s_balance('raw_text')} AS balanced FROM v_raw"))
def balance_quote(spark, sf):
    return fx.raw_generations(spark, sf).select(*KEYS, "system", "setting", tx.balance_quote(F.col("raw_text")).alias("balanced"))


CLEANED = f"""
    SELECT doc_id, sent_id, system, setting,
           CASE WHEN bare = '' THEN '' ELSE {s_balance('sentence')} END AS adv_text
    FROM (SELECT *, {s_first_sentence('answer')} AS sentence
          FROM (SELECT *, {s_answer('bare')} AS answer
                FROM (SELECT doc_id, sent_id, system, setting, {s_markup('raw_text')} AS bare FROM v_raw)))"""


@query("clean_generated", using("v_raw", CLEANED))
def clean_generated(spark, sf):
    cleaned = answers.clean_generated(fx.raw_generations(spark, sf), "raw_text")
    return cleaned.select(*KEYS, "system", "setting", "adv_text")


def _sql_text(template: str) -> str:
    """A template as a SQL concatenation; the placeholders become columns."""
    parts = template.replace("'", "''").replace("{", "' || ").replace("}", " || '")
    return f"'{parts}'"


@query("render_prompt", using(
    "v_pair", f"""
    SELECT p.doc_id, p.sent_id, s.setting, CASE s.setting
        WHEN 'KB' THEN {_sql_text(prompts.TEMPLATES['KB'])} WHEN 'FS' THEN {_sql_text(prompts.TEMPLATES['FS'])}
        ELSE {_sql_text(prompts.ZERO_SHOT)} END AS prompt
    FROM v_pair p CROSS JOIN (SELECT unnest(['ZS', 'FS', 'KB']) AS setting) s
    CROSS JOIN (SELECT max(CASE WHEN label = 0 THEN examples END) AS class_0,
                       max(CASE WHEN label = 1 THEN examples END) AS class_1 FROM shown)""",
    shown="""SELECT label, string_agg(text, ' ' ORDER BY doc_id, sent_id) AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, sent_id) AS nth FROM v_pair)
        WHERE nth <= 5 GROUP BY label"""))
def render_prompt(spark, sf):
    pairs = fx.pairs(spark, sf)
    examples = prompts.class_examples(pairs, "text", "label", KEYS)
    rows = pairs.select(*KEYS, "text", F.explode(F.array(*map(F.lit, fx.SETTINGS))).alias("setting"))
    return rows.select(*KEYS, "setting", prompts.render_prompt(F.col("text"), F.col("setting"), examples).alias("prompt"))


@query("after_last_sep", using("v_raw", """
    SELECT doc_id, sent_id, system, setting, split_part(concat('a <sep> ', raw_text), '<sep>', -1) AS tail,
           split_part(raw_text, '<sep>', -1) AS plain FROM v_raw"""))
def after_last_sep(spark, sf):
    marked = F.concat(F.lit("a <sep> "), F.col("raw_text"))
    return fx.raw_generations(spark, sf).select(
        *KEYS, "system", "setting", tx.after_last_sep(marked).alias("tail"), tx.after_last_sep(F.col("raw_text")).alias("plain"))


@query("drop_turn_marks", using("v_raw", """
    SELECT doc_id, sent_id, system, setting, replace(concat('[SEP]', raw_text, '[SEP]'), '[SEP]', '') AS text FROM v_raw"""))
def drop_turn_marks(spark, sf):
    marked = F.concat(F.lit("[SEP]"), F.col("raw_text"), F.lit("[SEP]"))
    return fx.raw_generations(spark, sf).select(*KEYS, "system", "setting", tx.drop_turn_marks(marked).alias("text"))


@query("label_names", using("v_pred", """
    SELECT doc_id, CASE WHEN y = 0 THEN 'cc' ELSE 'ad' END AS truth, CASE WHEN yhat = 0 THEN 'cc' ELSE 'ad' END AS predicted,
           y AS back FROM v_pred"""))
def label_names(spark, sf):
    names = {0: "cc", 1: "ad"}
    named = fx.predicted(spark, sf).select(
        "doc_id", pairing.label_names(F.col("y"), names).alias("truth"), pairing.label_names(F.col("yhat"), names).alias("predicted"))
    return named.withColumn("back", pairing.label_numbers(F.col("truth"), names))


@query("knob_key", "SELECT event_id, replace(props, '\"', '') AS knob FROM events")
def knob_key(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", tx.knob_key(F.col("props")).alias("knob"))


@query("truncate_words", "SELECT doc_id, " + ", ".join(
    f"array_to_string({s_words('text')}[1:{n}], ' ') AS cut_{n}" for n in (50, 60, 100, 256)) + " FROM documents")
def truncate_words(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", *[tx.truncate_words(F.col("text"), n).alias(f"cut_{n}") for n in (50, 60, 100, 256)])


def s_rewrite(x: str) -> str:
    """Stutters, fillers and repeats, as list expressions."""
    joined = f"""list_transform({s_words(x)}, lambda w: CASE
        WHEN contains(w, '-') AND len(list_distinct(string_split(lower(w), '-'))) = 1 AND split_part(w, '-', 1) <> ''
        THEN split_part(w, '-', 1) ELSE w END)"""
    spoken = f"""list_filter({joined}, lambda w: regexp_replace(lower(w), '[.,!?]+$', '')
        NOT IN ('uh', 'um', 'uhm', 'er', 'erm', 'ah', 'hm', 'hmm', 'mhm'))"""
    return spoken


def s_collapse(words: str) -> str:
    stem = lambda w: f"lower(regexp_replace({w}, ',+$', ''))"
    return f"""array_to_string(list_filter({words}, lambda w, i: i = len({words})
        OR {stem('w')} <> {stem(f'{words}[i + 1]')}), ' ')"""


def rewrite_sql(source: str, keys: str, text: str = "text") -> str:
    return f"SELECT {keys}, {s_collapse('spoken')} AS rewritten FROM (SELECT {keys}, {s_rewrite(text)} AS spoken FROM {source})"


@query("disfluency_rewrite", using("v_pair", rewrite_sql("uttered", "doc_id, sent_id"), uttered="""
    SELECT doc_id, sent_id, replace(replace('Um, I, I ' || text, ' the ', ' the-the uh, the '), ', ', ', uh ') AS text FROM v_pair"""))
def disfluency_rewrite(spark, sf):
    """The given texts have few disfluencies, so some are put in at common words first."""
    spoken = F.replace(F.replace(F.concat(F.lit("Um, I, I "), F.col("text")), F.lit(" the "), F.lit(" the-the uh, the ")),
                       F.lit(", "), F.lit(", uh "))
    return fx.pairs(spark, sf).select(*KEYS, tx.disfluency_rewrite(spoken).alias("rewritten"))
