"""Literal rows for every cleaning rule."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import answers as an
from palimpsest.functions import text as tx
from palimpsest.functions.answers import GEMMA, LLAMA3, MISTRAL, PHI3


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


ANSWERS = [
    # system, setting, text without markup, answer
    (PHI3, "ZS", "Dementia: a b. Healthy: one healthy: two. three", " two"),
    (PHI3, "ZS", "plain one. plain two", "plain one"),
    (PHI3, "FS", "Healthy: x y; z. rest", " x y"),
    (PHI3, "FS", "no marker. rest", "no marker"),
    (PHI3, "KB", "Output sentence: 'a'. more Output: b", " 'a'"),
    (PHI3, "KB", "Output: b c. more", " b c"),
    (PHI3, "KB", "kept. as it is; but cut", "kept. as it is"),
    (PHI3, "other", "left. alone; cut", "left. alone"),
    (MISTRAL, "ZS", "Dementia: a. Healthy: b c. d e.", " b c. "),
    (MISTRAL, "ZS", " Dementia: a b. c d ", " a b. "),
    (MISTRAL, "ZS", "Dementia: only. ", " only."),
    (MISTRAL, "ZS", "I say Healthy: b. c", "I say Healthy: b. c"),
    (MISTRAL, "FS", "Dementia: a. Healthy: b. c", " b"),
    (MISTRAL, "FS", "Dementia: a b. c", " a b"),
    (MISTRAL, "FS", "so Healthy: a Healthy: b. c", " b"),
    (MISTRAL, "FS", "no marker. c", "no marker. c"),
    (MISTRAL, "FS", "Dementia:\tnot led. c", "Dementia:\tnot led. c"),
    (MISTRAL, "KB", "first. second", "first"),
    (MISTRAL, "other", "first. second", "first"),
    (GEMMA, "ZS", "Output: x", ""),
    (GEMMA, "FS", "Output: x", ""),
    (GEMMA, "KB", "Output: x. Rewrite: y. z", " y"),
    (GEMMA, "KB", "Rewritten sentence: a. Output: b", " a"),
    (GEMMA, "KB", "Output sentence: a. Rewritten sentence: b", " a"),
    (GEMMA, "KB", "Source: s. Output: b. c", " b"),
    (GEMMA, "KB", "Source: s. c", " s"),
    (GEMMA, "KB", "none. of them", "none. of them"),
    (GEMMA, "other", "Output: x. y", "Output: x. y"),
    (LLAMA3, "ZS", "Output: x", ""),
    (LLAMA3, "FS", "Healthy: x", ""),
    (LLAMA3, "KB", "Healthy: a. Output: b. c", " b"),
    (LLAMA3, "KB", "Source: s. Healthy: a. c", " a"),
    (LLAMA3, "KB", "Source: s. c", " s"),
    (LLAMA3, "KB", "none. of them", "none. of them"),
    ("unknown", "KB", "Output: b. c; d", "Output: b. c; d"),
    (PHI3, "KB", "Output: one Output: two. x", " one O"),   # the piece between two markers
]


def test_extract_answer(spark):
    rows = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ANSWERS)], "i int, system string, setting string, t string")
    got = [r["answer"] for r in an.extract_answer(rows, "t").orderBy("i").collect()]
    assert got == [a[3] for a in ANSWERS]


def test_strip_markup_in_order(spark):
    cases = {
        'say "this"  ': "say this", "a (b) [c] *d*\ne": "a   de", "(open": "(open", "[x) y]": "[x) y]",
        "[a] b [c]": "", "tail \n (note)": "tail  ", 'x "\t': "x", "": "",
    }
    assert values(spark, cases, tx.strip_markup) == list(cases.values())


def test_first_sentence(spark):
    cases = {
        "One. Two.": "One. ", "One.\nTwo": "One.\n", "No end here  ": "No end here", "Ends here.": "Ends here.",
        "3.5 is one! two": "3.5 is one! ", "": "", "   ": "", "line\nbreak? yes": "line\nbreak? ", "a. b": "a. ",
    }
    assert values(spark, cases, tx.first_sentence) == list(cases.values())


def test_balance_quote(spark):
    cases = {"'open": "'open'", "'closed'": "'closed'", "plain'": "plain'", "": "", "'": "'"}
    assert values(spark, cases, tx.balance_quote) == list(cases.values())


def test_clean_generated(spark):
    rows = spark.createDataFrame(
        [(0, PHI3, "KB", '"Output: It is *fine*. More" (note)'), (1, PHI3, "KB", '"" '), (2, "unknown", "KB", "'Quoted one. Two"),
         (3, GEMMA, "ZS", "anything"), (4, MISTRAL, "ZS", "Dementia: a. Healthy: 'b c! d e")],
        "i int, system string, setting string, raw string")
    got = [r["adv_text"] for r in an.clean_generated(rows, "raw").orderBy("i").collect()]
    assert got == [" It is fine", "", "'Quoted one. '", "", " 'b c! "]


def test_word_and_field_filters_differ(spark):
    texts = ["a  b ", "a b c", "a b c d", "", "   ", "a\tb\nc d"]
    assert values(spark, texts, lambda c: tx.has_min_words(c, 3)) == [False, True, True, False, False, True]
    assert values(spark, texts, lambda c: tx.has_min_words(c, 4)) == [False, False, True, False, False, True]
    assert values(spark, texts, tx.has_min_fields) == [True, False, True, False, True, False]


def test_small_steps(spark):
    assert values(spark, ["a <sep> b<sep>c", "none"], tx.after_last_sep) == ["c", "none"]
    assert values(spark, ["[SEP]a[SEP] b", "c"], tx.drop_turn_marks) == ["a b", "c"]
    assert values(spark, ['{"k": 1, "m": "x"}', "0.5"], tx.knob_key) == ["{k: 1, m: x}", "0.5"]
    assert values(spark, [" a  b\tc d", ""], lambda c: tx.truncate_words(c, 3)) == ["a b c", ""]


def test_disfluency_rewrite(spark):
    cases = {
        "I, I went uh home": "I went home", "the the the dog": "the dog", "I-I see": "I see", "Um, well-known the-The one": "well-known the one",
        "go. Go now": "go. Go now", "": "", "uh": "", "a uh a b": "a b", "very, very, very good": "very good",
    }
    assert values(spark, cases, tx.disfluency_rewrite) == list(cases.values())


def test_content_tokens(spark):
    got = values(spark, ["Don't the girl's 2 well-known dogs run, été?", ""], tx.content_tokens)
    assert got == [["girl", "dogs", "run", "été"], []]


def test_ngrams(spark):
    got = values(spark, ["a b c", "a", ""], lambda c: tx.ngrams(tx.words(c), 2))
    assert got == [["a b", "b c"], [], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='ab.!?()[]*"\n \';:', max_size=40), min_size=1, max_size=20))
def test_cleaning_leaves_no_markup(spark, texts):
    rows = spark.createDataFrame([(t, s, k) for t in texts for s in (PHI3, "unknown") for k in ("ZS", "KB")],
                                 "raw string, system string, setting string")
    for r in an.clean_generated(rows, "raw").collect():
        assert not set('"*\n') & set(r["adv_text"])
        assert "(" not in r["adv_text"] or ")" not in r["adv_text"].split("(", 1)[1]


@pytest.mark.parametrize("text,pieces", [("One. Two! Three", ["One.", "Two!", "Three"]), ("3.5 m", ["3.5 m"]), ("End. ", ["End.", ""])])
def test_sentences(spark, text, pieces):
    assert values(spark, [text], tx.sentences) == [pieces]


def test_long_blank_runs_are_passed_over_once(spark):
    text = "a" + " " * 200_000 + "b" + " " * 200_000
    assert values(spark, [text], tx.rstrip) == [text.rstrip()]
    assert values(spark, [text], tx.first_sentence) == [text.rstrip()]
    assert values(spark, [text], tx.strip) == [text.strip()]
    assert values(spark, [" \n a. \x1c\u00a0"], tx.strip) == ["a."]
