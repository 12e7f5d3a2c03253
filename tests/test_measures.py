"""Text measures against direct loops."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import similarity as sim
from palimpsest.functions import text as tx
from palimpsest.operators import metrics as mt
from palimpsest.operators import trees, vectors
from palimpsest.operators import vocabulary as voc

WORDS = st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=9)


def least_edits(ref, hyp):
    """(cost, s, i, d), least in this order, by the plain table of all prefixes."""
    table = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            ways = []
            if i and j:
                c, s, n, d = table[i - 1, j - 1]
                ways.append((c, s, n, d) if ref[i - 1] == hyp[j - 1] else (c + 1, s + 1, n, d))
            if i:
                c, s, n, d = table[i - 1, j]
                ways.append((c + 1, s, n, d + 1))
            if j:
                c, s, n, d = table[i, j - 1]
                ways.append((c + 1, s, n + 1, d))
            if ways:
                table[i, j] = min(ways)
    return table[len(ref), len(hyp)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=6))
def test_edit_counts(pairs):
    got = sim.edit_counts([p[0] for p in pairs], [p[1] for p in pairs])
    for (ref, hyp), row in zip(pairs, got):
        cost, subs, ins, dels, n, m = (int(x) for x in row)
        assert (cost, subs, ins, dels) == least_edits(ref, hyp)
        assert cost == subs + ins + dels and ins - dels == m - n and (n, m) == (len(ref), len(hyp))


def test_edit_counts_in_many_blocks(monkeypatch):
    monkeypatch.setattr(sim, "_BLOCK_CELLS", 40)
    rng = random.Random(0)
    refs, hyps = ([[rng.choice("abcde") for _ in range(rng.randrange(30))] for _ in range(60)] for _ in range(2))
    got = sim.edit_counts(refs, hyps)
    assert [tuple(int(x) for x in r[:4]) for r in got] == [least_edits(r, h) for r, h in zip(refs, hyps)]


def test_edit_words(spark):
    rows = spark.createDataFrame([(" a  b \t c d\te ",), ("",), ("  ",)], "t string")
    assert [r[0] for r in rows.select(tx.edit_words(F.col("t"))).collect()] == [["a", "b", "c", "d\te"], [], []]


def edit_distance(x, y):
    return least_edits(list(x), list(y))[0]


def test_lexical_overlap(spark):
    cases = [(["cat", "dog"], ["cat", "dig"]), (["été"], ["ete"]), ([], []), (["a"], []), (["same"], ["same"])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = [r[0] for r in rows.orderBy("i").select(sim.lexical_overlap(F.col("a"), F.col("b"))).collect()]

    def alike(x, y):
        return 1 - edit_distance(x, y) / max(len(x), len(y))

    for (a, b), score in zip(cases, got):
        if not a and not b:
            assert score == 1.0
        else:
            total = sum(max((alike(x, y) for y in b), default=0) for x in a) + sum(max((alike(x, y) for x in a), default=0) for y in b)
            assert score == pytest.approx(total / (len(a) + len(b)))


def test_meteor(spark):
    cases = [("the cat sat", "the cat sat"), ("the cat sat on", "on the cat"), ("a b", "c d"), ("", "x"), ("b a b", "b b a")]
    rows = spark.createDataFrame([(i, r.split(), h.split()) for i, (r, h) in enumerate(cases)], "i int, r array<string>, h array<string>")
    scored = rows.withColumn("f", sim.matched_chunks(F.col("r"), F.col("h"))).withColumn(
        "s", sim.meteor_score(F.col("f"), F.size("h"), F.size("r"))).orderBy("i").collect()
    assert [(r.f.matches, r.f.chunks) for r in scored] == [(3, 1), (3, 2), (0, 0), (0, 0), (3, 3)]
    assert scored[0].s == pytest.approx(1 - 0.5 / 27)
    p, q = 1.0, 0.75
    assert scored[1].s == pytest.approx(p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (2 / 3) ** 3))
    assert scored[2].s == 0 and scored[3].s == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=3, max_size=3), min_size=2, max_size=6))
def test_cosine(spark, vs):
    rows = spark.createDataFrame([(a, b) for a in vs for b in vs], "a array<double>, b array<double>")
    for r in rows.select("a", "b", sim.cosine(F.col("a"), F.col("b")).alias("c"), sim.cosine(F.col("b"), F.col("a")).alias("d")).collect():
        if r.c is not None:
            assert -1 - 1e-9 <= r.c <= 1 + 1e-9 and r.c == pytest.approx(r.d)


def test_argmax_and_softmax(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 1001.0, 0.0],)], "x array<double>")
    got = rows.select(sim.argmax(F.col("x")), sim.softmax_positive(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 1]
    assert got[1][1] == pytest.approx(1 / (1 + math.exp(-1)))


def test_tfidf_and_cosine(spark):
    train = spark.createDataFrame([(1, "aa bb bb"), (2, "aa cc")], "id long, t string")
    other = spark.createDataFrame([(3, "aa bb zz")], "id long, t string")
    got = {r.term: r.weight for r in voc.tfidf(train, other, ["id"], tx.tokens(F.col("t"))).collect()}
    a, b = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    norm = math.hypot(a, b)
    assert got == {"aa": pytest.approx(a / norm), "bb": pytest.approx(b / norm)}
    pairs = spark.createDataFrame([(1, "aa bb", "aa bb"), (2, "aa", "cc"), (3, "aa", ""), (4, "", "")], "id long, x string, y string")
    cos = {r.id: r.tfidf_cosine for r in voc.tfidf_cosine(pairs, ["id"], tx.tokens(F.col("x")), tx.tokens(F.col("y"))).collect()}
    assert cos == {1: pytest.approx(1.0), 2: 0.0, 3: None}


def test_perplexity(spark):
    corpus = spark.createDataFrame([("aa bb aa bb cc",)], "t string")
    texts = spark.createDataFrame([(1, "aa bb cc"), (2, "cc aa zz"), (3, "aa")], "id long, t string")
    got = {r.id: r.perplexity for r in voc.perplexity(corpus, tx.tokens(F.col("t")), texts, ["id"], tx.tokens(F.col("t"))).collect()}
    v, k = 3, 0.1
    p1 = [(2 + k) / (2 + k * v), (1 + k) / (2 + k * v)]
    p2 = [(0 + k) / (0 + k * v), (0 + k) / (2 + k * v)]
    assert got == {i: pytest.approx(math.exp(-np.mean(np.log(p)))) for i, p in ((1, p1), (2, p2))}


def test_perplexity_does_not_shuffle_bigrams_by_text(spark):
    corpus = spark.createDataFrame([("aa bb aa bb cc",), ("bb cc",)], "t string")
    texts = spark.createDataFrame([(1, "aa bb aa bb"), (1, "bb cc"), (None, "aa bb"), (2, "aa"), (3, None)], "id int, t string")   # repeated and null keys
    found = voc.perplexity(corpus, tx.tokens(F.col("t")), texts, ["id"], tx.tokens(F.col("t")))
    pair = {"ab": (2, 2), "ba": (1, 3), "bc": (2, 3)}   # count of the pair, and of pairs that begin so
    logs = {k: math.log((n + 0.1) / (of + 0.1 * 3)) for k, (n, of) in pair.items()}
    got = {r.id: r.perplexity for r in found.collect()}
    assert got == pytest.approx({1: math.exp(-(2 * logs["ab"] + logs["ba"] + logs["bc"]) / 4), None: math.exp(-logs["ab"])})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and not any("hashpartitioning(id" in line and "w1" in line.split("hashpartitioning")[1] for line in plan.split("\n"))


def test_rouge_and_bleu(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "a b c d x"), (2, "", ""), (3, "a a", "a")], "id long, r string, h string")
    ref, hyp = tx.words(F.col("r")), tx.words(F.col("h"))
    rouge = {r.id: (r.recall, r.precision) for r in voc.rouge_n(rows, ["id"], ref, hyp, 1).collect()}
    assert rouge == {1: (0.8, 0.8), 2: (0, 0), 3: (0.5, 1.0)}
    bleu = {r.id: r.bleu for r in voc.bleu_n(rows, ["id"], ref, hyp).collect()}
    assert bleu[1] == pytest.approx((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25) and bleu[2] == 0 and bleu[3] == 0


def test_tree_templates(spark):
    rows = spark.createDataFrame([(1, "(ROOT (S (NP (PRP I)) (VP (VBD ran) (PP (IN to) (NP (NN town))))))"), (2, "(X word)")], "id long, p string")
    got = {r.id: r.template for r in trees.tree_templates(rows, ["id"], trees.parse_marks(F.col("p"))).collect()}
    assert got == {1: "(ROOT (S (NP (PRP )) (VP (VBD ) (PP ))))", 2: "(X )"}
    pages = spark.createDataFrame([(1, "<div><p>a<br>b</p><i>c</i></div>")], "id long, h string")
    got = trees.tree_templates(pages, ["id"], trees.tag_marks(F.col("h"))).first().template
    assert got == "(div (p (br )) (i ))"


def test_mean_pool(spark):
    rows = spark.createDataFrame([("k", [1.0, 2.0], 1), ("k", [3.0, 4.0], 1), ("k", [9.0, 9.0], 0)], "k string, v array<double>, m int")
    assert vectors.mean_pool(rows, ["k"], "v", "m").first()["mean"] == [2.0, 3.0]


# metrics -------------------------------------------------------------------------------------

@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=30))
def test_binary_metrics(spark, pairs):
    r = mt.binary_metrics(spark.createDataFrame(pairs, "y int, yhat int")).first()
    n = {(y, p): sum(1 for q in pairs if q == (y, p)) for y in (0, 1) for p in (0, 1)}
    tp, tn, fp, fn = n[1, 1], n[0, 0], n[0, 1], n[1, 0]
    ratio = lambda a, b: a / b if b else 0.0
    assert r.accuracy == pytest.approx((tp + tn) / len(pairs))
    assert (r.recall, r.recall_0) == (pytest.approx(ratio(tp, tp + fn)), pytest.approx(ratio(tn, tn + fp)))
    assert (r.precision, r.precision_0) == (pytest.approx(ratio(tp, tp + fp)), pytest.approx(ratio(tn, tn + fn)))
    assert (r.f1, r.f1_0) == (pytest.approx(ratio(2 * tp, 2 * tp + fp + fn)), pytest.approx(ratio(2 * tn, 2 * tn + fp + fn)))
    assert r.mcc == pytest.approx(ratio(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))


def test_metric_by_class_skips_nan(spark):
    rows = spark.createDataFrame([("m", 0, 1.0), ("m", 0, float("nan")), ("m", 1, 3.0), ("m", 1, None)], "model string, label int, s double")
    got = {r.label_group: (r.value, r["std"]) for r in mt.metric_by_class(rows, ["s"], ["model"]).collect()}
    assert got == {"ALL": (2.0, 1.0), "CC": (1.0, 0.0), "AD": (3.0, 0.0)}


def test_edit_rates_are_means_of_ratios(spark):
    rows = spark.createDataFrame([("a b c d", "a b c x"), ("a", "a b"), ("", "z")], "r string, h string")
    ops = rows.select(sim.word_edit_ops(tx.edit_words(F.col("r")), tx.edit_words(F.col("h"))).alias("ops"))
    r = mt.edit_rates(ops, "ops").first()
    assert (r.SUB, r.ADD, r.DEL) == (pytest.approx(0.125), pytest.approx(0.5), 0.0)   # an empty reference has no rate
