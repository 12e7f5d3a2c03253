"""Row numbers, batches, neighbours and logs against brute force, with one key that holds most rows."""

import random

import numpy as np
import pytest

from palimpsest.operators import documents as docs
from palimpsest.operators import numbering as num
from palimpsest.operators import training_log as tl


@pytest.fixture(scope="module")
def skewed():
    """(doc, place) rows: document 7 holds most of them, and places have gaps."""
    rng = random.Random(1)
    rows = [(7, p) for p in range(0, 400, 1 + rng.randrange(2)) if rng.random() < 0.7]
    rows += [(d, p) for d in range(20) if d != 7 for p in sorted(rng.sample(range(30), rng.randrange(1, 6)))]
    rng.shuffle(rows)
    return rows


def test_row_ids(spark, skewed):
    df = spark.createDataFrame(skewed, "doc long, place long")
    got = {(r.doc, r.place): (r.row_id, r.pos) for r in num.row_ids(df, ["doc"], ["place"], partitions=5).collect()}
    first = {}
    for at, (doc, place) in enumerate(sorted(skewed)):
        first.setdefault(doc, at)
        assert got[doc, place] == (at, at - first[doc])


@pytest.mark.parametrize("size", [1, 3, 32, 10_000])
def test_split_batches(spark, skewed, size):
    df = spark.createDataFrame(skewed, "doc long, place long")
    got = {(r.doc, r.place): r.batch for r in num.split_batches(df, ["doc", "place"], size).collect()}
    parts = np.array_split(np.arange(len(skewed)), -(-len(skewed) // size))
    want = {sorted(skewed)[at]: k for k, part in enumerate(parts) for at in part}
    assert got == want


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_head_fraction(spark, skewed, fraction):
    df = spark.createDataFrame(skewed, "doc long, place long")
    got = sorted((r.doc, r.place) for r in num.head_fraction(df, ["doc", "place"], fraction).collect())
    assert got == sorted(skewed)[:int(len(skewed) * fraction)]


def test_shuffle_does_not_depend_on_partitions(spark, skewed):
    one = spark.createDataFrame(skewed, "doc long, place long").coalesce(1)
    many = spark.createDataFrame(sorted(skewed), "doc long, place long").repartition(6)
    a, b = (sorted(map(tuple, num.seeded_shuffle(d, ["doc", "place"], 5).collect())) for d in (one, many))
    c = sorted(map(tuple, num.seeded_shuffle(one, ["doc", "place"], 6).collect()))
    assert a == b and a != c
    assert sorted(r[2] for r in a) == list(range(len(skewed)))


@pytest.mark.parametrize("width", [1, 4, 64, 4096])
def test_next_in_sequence(spark, skewed, width):
    df = spark.createDataFrame([(d, p, f"{d}-{p}", None if p % 3 == 0 else p) for d, p in skewed], "doc long, place long, t string, n long")
    got = {(r.doc, r.place): (r.next_t, r.next_n) for r in num.next_in_sequence(df, ["doc"], "place", ["t", "n"], width=width).collect()}
    order = sorted(skewed)
    for here, after in zip(order, order[1:] + [(None, None)]):
        same = after[0] == here[0]
        want = (f"{after[0]}-{after[1]}", None if after[1] % 3 == 0 else after[1]) if same else (None, None)
        assert got[here] == want
    assert len(got) == len(skewed)


@pytest.mark.parametrize("width", [1, 4, 32, 4096])
def test_early_stopping(spark, width):
    rng = random.Random(2)
    log = [(run, step, float(rng.randrange(12))) for run, n in ((1, 150), (2, 3), (3, 1), (4, 9)) for step in range(1, n + 1)]
    want = {}
    for run in {r for r, _, _ in log}:
        best, waited = float("inf"), 0
        for _, step, loss in sorted(x for x in log if x[0] == run):
            best, waited = (loss, 0) if loss < best else (best, waited + 1)
            want[run, step] = (best, waited, waited >= 3)
    rng.shuffle(log)
    df = spark.createDataFrame(log, "run_id long, step long, val_loss double")
    got = {(r.run_id, r.step): (r.best_loss, r.no_improvement, r.stop) for r in tl.early_stopping(df, patience=3, width=width).collect()}
    assert got == want


def test_best_n(spark):
    df = spark.createDataFrame([(1, s, float(l)) for s, l in enumerate([5, 2, 2, 1, 9])], "run_id long, step long, val_loss double")
    got = [(r.step, r["rank"]) for r in tl.best_n_checkpoints(df, 3).orderBy("rank").collect()]
    assert got == [(3, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("width", [1, 8, 1024])
def test_assemble_docs(spark, skewed, width):
    rows = [(d, d % 2, p, None if p % 11 == 5 else f"s{p}" if p % 7 else "") for d, p in skewed]
    df = spark.createDataFrame(rows, "doc long, label int, place long, t string")
    got = {r.doc: r.t for r in docs.assemble_docs(df, ["doc", "label"], "place", "t", width=width).collect()}
    for doc in {d for d, _ in skewed}:
        said = [t for d, _, p, t in sorted(rows, key=lambda r: r[:3]) if d == doc and t is not None]
        assert got[doc] == (".".join(said) if said else None)


def test_pair_documents_keyed_and_positional(spark):
    """Documents with both labels: by position the rewrites slide to other documents and run out."""
    originals = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")], "doc long, label int, text string")
    by_both = spark.createDataFrame([(2, 1, "D"), (1, 0, "A"), (1, 1, "B"), (2, 0, "C")], "doc long, label int, adv string")
    by_doc = spark.createDataFrame([(1, "AB"), (2, "CD")], "doc long, adv string")
    keyed = docs.pair_documents(originals, by_both, ["doc", "label"]).orderBy("doc", "label").collect()
    assert [(r.text, r.adv) for r in keyed] == [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")]
    placed = docs.pair_documents_by_position(originals, by_doc, ["doc", "label"], ["doc"], "adv").orderBy("row_id").collect()
    assert [(r.text, r.adv) for r in placed] == [("a", "AB"), ("b", "CD"), ("c", None), ("d", None)]
