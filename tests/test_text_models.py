"""Classifiers on exact terms: optimum, many sets at once, blocks, forests."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators.term_blocks import INTERCEPT
from palimpsest.plans import forest as fo
from palimpsest.plans import kernel
from palimpsest.plans import linear
from palimpsest.plans import models as md
from palimpsest.plans import text_models as tm
from palimpsest.workspace import fresh_path

TOKEN = re.compile(r"\w{2,}")


def texts(seed, n, words=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.randint(0, 1)
        pool = [f"w{rng.randint(0, words)}" for _ in range(rng.randint(0, 12))] + (["good", "fine"] if label else ["bad"]) * rng.randint(0, 2)
        rows.append((i, " ".join(pool), label))
    return rows + [(n, None, 1), (n + 1, "", 0), (n + 2, "bad bad good", None), (n + 3, "w1 w2", 1), (n + 4, "w1 w2", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)


def matrix(rows, feature="TFIDF"):
    rows = [(TOKEN.findall((t or "").lower()), y) for _, t, y, *_ in rows if y is not None]
    terms = sorted({w for ws, _ in rows for w in ws})
    df = {w: sum(w in ws for ws, _ in rows) for w in terms}
    x = np.array([[ws.count(w) * (math.log((1 + len(rows)) / (1 + df[w])) + 1 if feature == "TFIDF" else 1) for w in terms] for ws, _ in rows])
    if feature == "TFIDF":
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = x / np.where(norm > 0, norm, 1)
    return terms, np.hstack([x, np.ones((len(rows), 1))]), np.array([1.0 if y else -1.0 for _, y in rows])


def newton_logistic(x, y, cost):
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-y * (x @ w)))
        g = w - cost * x.T @ (y * (1 - p))
        h = np.eye(len(w)) + cost * (x * (p * (1 - p))[:, None]).T @ x
        w = w - np.linalg.solve(h, g)
    return w


def descent_hinge(x, y, cost):
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(len(y))
    for _ in range(20_000):
        worst = 0.0
        for i in range(len(y)):
            new = min(max(a[i] - (q[i] @ a - 1) / q[i, i], 0), cost)
            worst, a[i] = max(worst, abs(new - a[i])), new
        if worst < 1e-13:
            break
    return x.T @ (a * y)


def fitted(data, fit, loss, s=tm.ALL):
    term = {r.term_id: r.term for r in data.terms.where(F.col("set") == s).collect()}
    return {term.get(r.term_id, INTERCEPT): r.value for r in fit.weights.where((F.col("set") == s) & (F.col("loss") == loss)).collect()}


def prepared(spark, rows, feature, entries=10**6):
    train = frame(spark, rows).where("label IS NOT NULL").select("label", F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit(tm.ALL)).alias("sets"))
    return tm.term_blocks(tm.numbered_rows(train), tm.tokens(F.col("text")), feature, entries)


PROBLEMS = [linear.Problem(tm.ALL, "hinge", 0.5), linear.Problem(tm.ALL, "logistic", 1.5)]


@pytest.mark.parametrize("feature", ["TFIDF", "BOW"])
def test_weights_equal_a_plain_fit(spark, feature):
    rows = texts(1, 70)
    data = prepared(spark, rows, feature)
    assert data.sizes[tm.ALL] == (74, 1)
    fit = linear.fit_linear(data, PROBLEMS, tolerance=1e-13)
    assert all(g < 1e-12 for g in fit.gaps.values())
    terms, x, y = matrix(rows, feature)
    for loss, want in (("hinge", descent_hinge(x, y, 0.5)), ("logistic", newton_logistic(x, y, 1.5))):
        got = fitted(data, fit, loss)
        assert np.allclose([got.get(t, 0.0) for t in terms] + [got.get(INTERCEPT, 0.0)], want, atol=1e-6)


def test_blocks_come_as_near_as_their_gap_says(spark):
    rows = texts(1, 70)
    data = prepared(spark, rows, "TFIDF", 200)
    assert data.sizes[tm.ALL][1] > 2
    fit = linear.fit_linear(data, PROBLEMS, tolerance=0.02, rounds=60)
    assert all(0 <= g <= 0.02 for g in fit.gaps.values()) and 1 < fit.rounds < 60
    terms, x, y = matrix(rows, "TFIDF")
    for p, want in zip(PROBLEMS, (descent_hinge(x, y, 0.5), newton_logistic(x, y, 1.5))):
        got = fitted(data, fit, p.loss)
        w = np.array([got.get(t, 0.0) for t in terms] + [got.get(INTERCEPT, 0.0)])
        loss = np.maximum(0, 1 - y * (x @ w)) if p.loss == "hinge" else np.logaddexp(0, -y * (x @ w))
        assert ((w - want) ** 2).sum() <= 2 * 0.02 * (w @ w / 2 + p.cost * loss.sum()) * 1.01


def test_sets_fitted_together_equal_sets_fitted_alone(spark):
    a, b = texts(2, 50), texts(3, 40)
    both = frame(spark, a).withColumn("sets", F.array(F.lit("a"), F.lit("ab"))).unionByName(frame(spark, b).withColumn("sets", F.array(F.lit("b"), F.lit("ab"))))
    models = tm.fit_many(both, ["SVM", "LR", "RF"], sets="sets")
    asked = frame(spark, texts(4, 30))
    for name, rows in (("a", a), ("b", b), ("ab", a + b)):
        got = tm.predict_many(models, asked.withColumn("sets", F.array(F.lit(name), F.lit("no such set"))), sets="sets").collect()
        assert {r["set"] for r in got} == {name} and len(got) == 3 * 35
        want = tm.predict_many(tm.fit_many(frame(spark, rows), ["SVM", "LR"]), asked).collect()
        of = lambda found: {(r.doc_id, r.classifier): r.score for r in found if r.classifier != "RF"}
        assert of(got).keys() == of(want).keys() and all(abs(of(got)[k] - v) < 5e-3 for k, v in of(want).items())


def test_scores_follow_the_weights(spark):
    rows, asked = texts(5, 60), texts(6, 20) + [(999, "unknown words only", 0)]
    got = {(r.doc_id, r.classifier): (r.pred, r.score) for r in tm.predict_many(tm.fit_many(frame(spark, rows), ["LR", "SVM"]), frame(spark, asked)).collect()}
    terms, x, y = matrix(rows)
    w = newton_logistic(x, y, tm.linear_cost("LR", "TFIDF", len(y)))
    df = {t: (x[:, k] > 0).sum() for k, t in enumerate(terms)}
    for i, t, *_ in asked:
        ws = [v for v in TOKEN.findall((t or "").lower()) if v in df]
        v = np.array([ws.count(t) * (math.log((1 + len(y)) / (1 + df[t])) + 1) for t in terms])
        margin = (v @ w[:-1]) / (np.sqrt(v @ v) or 1) + w[-1]
        assert abs(got[i, "LR"][1] - 1 / (1 + math.exp(-margin))) < 1e-3
        assert got[i, "SVM"][0] == int(got[i, "SVM"][1] > 0)


def test_a_rare_deciding_term_is_kept_among_a_million(spark):
    rows = spark.range(2000).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(549)), lambda k: F.format_string("t%07d", F.col("id") * 550 + k)),
                                                F.when(F.col("id") == 7, "zzrare")).alias("text"), F.when(F.col("id") == 7, 1).otherwise(0).alias("label"))
    data = tm.training_blocks(rows, "BOW")
    assert data.terms.count() == 1_100_001 and data.terms.select("term_id").distinct().count() == 1_100_001
    fit = linear.fit_linear(data, [linear.Problem(tm.ALL, "hinge", 1.0)], rounds=3)
    rare = data.terms.where("term = 'zzrare'").first().term_id
    assert fit.weights.where((F.col("term_id") == rare) & (F.col("value") > 0)).count() == 1


def brute_forest(data, trees, depth, seed):
    """Every split by trying all terms on all rows."""
    rows = {}
    for b in data.blocks.collect():
        m = fo.Matrix(b.asDict())
        for k in range(len(m.rows)):
            rows[int(m.rows[k])] = ({int(t) for t in m.ids[m.cols[m.starts[k]:m.starts[k + 1]]]} - {INTERCEPT}, m.labels[k])
    terms = sorted({t for ts, _ in rows.values() for t in ts})
    tried = min(1.0, max(len(terms) ** 0.5, fo.LEAST_TRIED) / max(len(terms), 1))
    out = {}

    def grow(tree, node, members, level):
        n = [sum(w for i, w in members if (rows[i][1] > 0) == side) for side in (False, True)]
        out[tree, node] = [None, n]
        gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0
        best = None
        for t in terms if level < depth and n[0] and n[1] else []:
            if fo.hashed(seed, tree, np.array([node]), np.array([t]))[0] < tried:
                a = [sum(w for i, w in members if t in rows[i][0] and (rows[i][1] > 0) == side) for side in (False, True)]
                if sum(a) and sum(n) - sum(a):
                    gain = round(gini(*n) - gini(*a) - gini(n[0] - a[0], n[1] - a[1]), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, t)
        if best:
            out[tree, node][0] = best[1]
            for side in (False, True):
                grow(tree, 2 * node + side, [(i, w) for i, w in members if (best[1] in rows[i][0]) == side], level + 1)
    for tree in range(trees):
        ids = np.array(sorted(rows))
        grow(tree, 1, [(int(i), w) for i, w in zip(ids, fo.drawn(seed, tree, ids)) if w], 0)
    return out


@pytest.mark.parametrize("entries", [10**6, 150])
def test_forest_equals_brute_force(spark, entries):
    train = frame(spark, texts(7, 80, words=60)).where("label IS NOT NULL").select("label", F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit(tm.ALL)).alias("sets"))
    data = tm.term_blocks(tm.numbered_rows(train), tm.tokens(F.col("text")), "BOW", entries)
    got = fo.fit_forests(data, [tm.ALL], trees=3, depth=3, seed=5)[tm.ALL]
    want = brute_forest(data, 3, 3, 5)
    assert {k: (x.term_id, [x.n0, x.n1]) for k, x in got.items()} == {k: tuple(v) for k, v in want.items()}
    assert any(x.term_id is not None for x in got.values())


def test_saved_models_give_the_same_predictions(spark):
    models = tm.fit_many(frame(spark, texts(8, 60)), ["LR", "RF"])
    path = fresh_path(spark, "model")
    models.save(path)
    again = tm.TextModels.load(spark, path)
    asked = frame(spark, texts(9, 20))
    rows = [sorted(tuple(r) for r in tm.predict_many(m, asked.drop("label")).collect()) for m in (models, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 50


@pytest.mark.parametrize("rows", [[], [(1, "aa bb", 1), (2, "cc", 1)], [(1, None, 0), (2, "", 1)], [(1, "aa", None)]], ids=["empty", "one-class", "no-words", "no-labels"])
def test_defined_cases(spark, rows):
    models = tm.fit_many(frame(spark, rows), ["SVM", "LR", "RF"])
    got = tm.predict_many(models, frame(spark, [(5, "aa zz", 0), (6, None, 0)])).collect()
    labelled = [r for r in rows if r[2] is not None]
    assert len(got) == (6 if labelled else 0)
    if len({r[2] for r in labelled}) == 1:
        assert {r.pred for r in got} == {labelled[0][2]}


def test_adversaries_from_one_fit_equal_those_from_two(spark):
    train = frame(spark, [(i, f"{t} more words here", y) for i, t, y in texts(10, 60) if t and y is not None])
    knobs = train.select("doc_id", "label", F.inline(F.array(*[F.struct(F.lit("m").alias("model"), F.lit(k).alias("temperature"), F.concat("text", F.lit(f" {k}x")).alias("text")) for k in ("t0", "t1")])))
    sides = train.select(F.lit("Original").alias("model"), F.lit("None").alias("temperature"), "label", "text", F.lit(False).alias("new")).unionByName(
        knobs.select("model", "temperature", "label", "text", F.lit(True).alias("new")))
    by = ["model", "temperature"]
    one = md.adversaries(train, knobs, sides, F.col("new"), by, by, ["LR"])
    two = md.static_adversary(train, sides, by, ["LR"]).unionByName(md.adaptive_adversary(train, knobs, sides.where("new"), by, ["LR"], knob=by))
    rows = lambda df: sorted((*r[:-1], round(r.value, 9)) for r in df.collect())
    assert rows(one) == rows(two) and len(rows(one)) == 8 * 5


# kernel ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("gamma", [0.5, 1.0, 2.0])
def test_features_estimate_the_gaussian_kernel(spark, gamma):
    data = prepared(spark, texts(11, 40), "TFIDF")
    m = fo.Matrix(data.blocks.first().asDict())
    x = np.zeros((len(m.rows), len(m.ids)))
    x[m.of, m.cols] = m.vals
    x = x[:, m.ids != INTERCEPT]
    exact = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    z = kernel.projections(m, gamma, 8192, 1)
    assert np.abs(z @ z.T - exact).max() < 0.05
    again = kernel.projections(m, gamma, 8192, 1)
    assert (z == again).all() and np.abs(z @ z.T - exact).mean() < 0.01


def test_gamma_follows_the_variance(spark):
    data = prepared(spark, texts(12, 40), "TFIDF")
    _, x, _ = matrix(texts(12, 40))
    x = x[:, :-1]
    assert abs(kernel.scale_gamma(data) - 1 / (x.shape[1] * x.var())) < 1e-9


def test_kernel_separates_what_no_line_does(spark):
    rows = [(i, " ".join(["aa"] * (i % 2) + ["bb"] * (i // 2 % 2) + ["cc"]), int(i % 2 == i // 2 % 2)) for i in range(80)] + [(99, None, 1)]
    model = kernel.fit_kernel(frame(spark, rows), features=1024, cost=10.0, gamma=2.0)
    got = kernel.predict_kernel(model, frame(spark, rows[:8] + [(100, "unknown", 1), (101, None, 0)])).collect()
    assert len(got) == 10 and {r.doc_id: r.pred for r in got if r.doc_id < 99} == {i: y for i, _, y in rows[:8]} and model.gap < 1e-6


def test_weights_known_to_a_block_are_read_as_arrays():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from palimpsest.operators.term_blocks import BLOCK, INTERCEPT
    from palimpsest.plans import linear

    n = 200_000
    ids = np.append(INTERCEPT, np.arange(n))
    packed = {"rows": np.arange(2), "labels": np.array([0.0, 1.0]), "starts": np.array([0, n + 1, n + 2]), "ids": ids,
              "cols": np.append(np.arange(n + 1), 0).astype("<i4"), "vals": np.append(np.full(n + 1, 0.001), 1.0)}
    block = pa.table({"set": ["all"], "block": pa.array([0], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()}})
    assert [c.split()[0] for c in BLOCK.split(", ")] == block.column_names
    old = np.array([0.25, 0.5])
    known = pa.table({"loss": ["logistic"] * (n + 2), "term_id": pa.array([None, *ids.tolist()], pa.int64()), "value": pa.array([None] + [0.5] * (n + 1), pa.float64()),
                      "alpha": pa.array([old.tobytes()] + [None] * (n + 1), pa.binary())})
    alpha, terms, values = linear._of_loss(known, "logistic")
    assert alpha.tolist() == old.tolist() and terms.tolist() == ids.tolist() and set(values.tolist()) == {0.5}
    assert linear._of_loss(known, "hinge")[0] is None and not len(linear._of_loss(known, "hinge")[1])
    work = linear._round([linear.Problem("all", "logistic", 1.0)], {"all": (4, 2)}, 2, 1e-7)
    tracemalloc.start()
    out = work(block, known).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1 and len(np.frombuffer(out[0]["alpha"], "<f8")) == 2
    assert peak < 200 * n   # some arrays; a Python row each takes more than twice that


def test_a_round_of_one_block_among_several_is_single_steps(monkeypatch):
    """Conjugate gradients took 79 of 80 seconds of a round of a block of 2.5 million entries."""
    rng = np.random.default_rng(8)
    n, k = 60, 12
    x = np.hstack([rng.random((n, k)), np.ones((n, 1))])
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    m = object.__new__(linear.Matrix)
    m.rows, m.labels, m.ids, m.starts = np.arange(n), y, np.arange(k + 1), np.arange(n + 1) * (k + 1)
    m.cols, m.vals, m.of = np.tile(np.arange(k + 1), n), x.ravel(), np.repeat(np.arange(n), k + 1)
    monkeypatch.setattr(linear, "_between", lambda *_: pytest.fail("conjugate gradients in one block of two"))
    alpha, w = np.zeros(n), np.zeros(k + 1)
    linear._better_hinge(m, y, alpha, w, np.ones(n), 2, 1, 1e-7)
    assert ((alpha >= 0) & (alpha <= 1)).all() and alpha.any() and np.allclose(w, 2 * x.T @ (alpha * y))


@pytest.mark.parametrize("feature", ["TFIDF", "BOW"])
def test_a_set_of_several_blocks_is_fitted_whole(spark, feature):
    """Rounds of blocks had a gap of 0.02 after 60."""
    rows = texts(1, 70) + [(200 + i, "w1 w2 good", i % 2) for i in range(9)]  # equal rows in several blocks
    data = prepared(spark, rows, feature, 200)
    assert data.sizes[tm.ALL][1] > 2
    fit = linear.fit_linear(data, PROBLEMS, tolerance=1e-11, rounds=5)
    assert all(0 <= g <= 1e-11 for g in fit.gaps.values()) and len(fit.gaps) == 2
    terms, x, y = matrix(rows, feature)
    for p, want in zip(PROBLEMS, (descent_hinge(x, y, 0.5), newton_logistic(x, y, 1.5))):
        got = fitted(data, fit, p.loss)
        assert np.allclose([got.get(t, 0.0) for t in terms] + [got.get(INTERCEPT, 0.0)], want, atol=1e-6)


def test_a_larger_set_goes_by_blocks_beside_whole_ones(spark, monkeypatch):
    rows = [(*r, [tm.ALL, "large"] if r[0] < 30 else ["large"]) for r in texts(1, 70) if r[2] is not None]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int, sets array<string>").select("label", F.coalesce("text", F.lit("")).alias("text"), "sets")
    data = tm.term_blocks(tm.numbered_rows(train), tm.tokens(F.col("text")), "TFIDF", 60)
    assert all(k > 1 for _, k in data.sizes.values())
    monkeypatch.setattr(linear, "WHOLE", 300)
    fit = linear.fit_linear(data, [linear.Problem(s, "logistic", 1.5) for s in (tm.ALL, "large", "none")], tolerance=1e-3, rounds=150)
    assert fit.gaps.keys() == {(tm.ALL, "logistic"), ("large", "logistic")} and all(0 <= g <= 1e-3 for g in fit.gaps.values()) and fit.rounds > 2
    for s, part in ((tm.ALL, [r for r in rows if r[0] < 30]), ("large", rows)):
        terms, x, y = matrix(part)
        got, want = fitted(data, fit, "logistic", s), newton_logistic(x, y, 1.5)
        w = np.array([got.get(t, 0.0) for t in terms] + [got.get(INTERCEPT, 0.0)])
        assert ((w - want) ** 2).sum() <= 2e-3 * (w @ w / 2 + 1.5 * np.logaddexp(0, -y * (x @ w)).sum()) * 1.01


def sparse(x):
    cells = [np.flatnonzero(r) for r in x]
    return linear.Matrix.of_arrays(np.arange(len(x)), np.ones(len(x)), np.concatenate([[0], np.cumsum([len(c) for c in cells])]), np.arange(x.shape[1]),
                                   np.concatenate(cells).astype("<i4"), np.concatenate([r[c] for r, c in zip(x, cells)]))


@pytest.mark.parametrize("cells", [0, 200, 10**6])
def test_products_with_a_gram_table_that_is_not_made(cells):
    rng = np.random.default_rng(3)
    x = np.hstack([rng.random((60, 90)) * (rng.random((60, 90)) < 0.03), np.ones((60, 1))])
    by, some = rng.standard_normal(60), np.flatnonzero(rng.random(60) < 0.5)
    for rows in (None, some):
        z = (x * by[:, None])[slice(None) if rows is None else rows]
        a = rng.standard_normal(len(z))
        assert np.allclose(linear.Gram(sparse(x), by, rows, cells).times(a), z @ (z.T @ a))


def test_features_are_made_some_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    m = sparse(np.hstack([rng.random((40, 30)) * (rng.random((40, 30)) < 0.2), np.ones((40, 1))]))
    want = kernel.projections(m, 1.0, 70, 1)
    monkeypatch.setattr(kernel, "CELLS", 7)
    assert (kernel.projections(m, 1.0, 70, 1) == want).all()
    taken = []
    add = np.add

    class Watched:
        def reduceat(self, cells, *a, **k):
            taken.append(len(cells))
            return add.reduceat(cells, *a, **k)
    monkeypatch.setattr(kernel.np, "add", Watched())
    kernel.projections(m, 1.0, 70, 1)
    assert max(taken) < 7 + 31   # of some 270 entries
