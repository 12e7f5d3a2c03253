"""Reports that take in new rows, and metrics of the caller's own."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import metrics as mt
from palimpsest.plans import quality
from palimpsest.plans import text_models as tm


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([0, 1, 1, None, 7]), rng.choice([None, float("nan"), rng.gauss(1e6, 1)]), rng.random()) for _ in range(n)]


SCHEMA = "model string, label int, x double, y double"


@pytest.mark.parametrize("cuts", [[0, 300], [0, 1, 2, 150, 300], [0, 0, 100, 300]])
def test_merged_parts_equal_the_whole(spark, cuts):
    data = rows(1, 300)
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    out = None
    for a, z in zip(cuts, cuts[1:]):
        part = mt.metric_moments(frame(data[a:z]), ["x", "y"], ["model"])
        out = part if out is None else out.unionByName(part)
    got = mt.moments_report(mt.merge_moments(out, ["model"]), ["model"]).collect()
    want = mt.metric_by_class(frame(data), ["x", "y"], ["model"]).collect()
    key = lambda r: (r.model or "", r.label_group, r.metric)
    assert sorted(map(key, got)) == sorted(map(key, want))
    found = {key(r): r for r in got}
    for r in want:
        g = found[key(r)]
        assert (g.value is None) == (r.value is None)
        if r.value is not None:
            assert abs(g.value - r.value) <= 1e-9 * max(1, abs(r.value)) and abs(g["std"] - r["std"]) <= 1e-9 * max(1, r["std"], abs(r.value) * 1e-6)


def test_merging_again_changes_nothing(spark):
    once = mt.merge_moments(mt.metric_moments(spark.createDataFrame(rows(2, 50), SCHEMA), ["y"], ["model"]), ["model"])
    twice = mt.merge_moments(once, ["model"])
    cells = lambda df: sorted(((r.model or "", r.label_group, r.n, round(r["mean"], 9), round(r.m2, 9)) for r in df.collect()))
    assert cells(once) == cells(twice)


def test_corpus_metrics_have_no_moments(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a b", 0)], "doc_id long, text string, adv_text string, label int")
    with pytest.raises(ValueError, match="semantics"):
        quality.quality_moments(pairs, ["doc_id"], [], ["semantics"])


def test_formality_and_embeddings_in_the_report(spark):
    train = spark.createDataFrame([(f"dear sir madam regards w{i % 5}" if i % 2 else f"hey dude lol w{i % 3}", i % 2) for i in range(40)], "text string, label int")
    pairs = spark.createDataFrame([(1, "hey dude what is up", "dear sir regards", 0), (2, "dear madam best regards to you", None, 1)], "doc_id long, text string, adv_text string, label int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0])], "doc_id long, u array<double>, v array<double>")
    extra = {"formality": quality.formality_metric(tm.fit_many(train, ["LR"])), "embedding": quality.cosine_metric(vectors, ["doc_id"], "u", "v")}
    report = quality.quality_report(pairs, ["doc_id"], [], ["meteor", "formality", "embedding"], extra=extra).collect()
    got = {(r.label_group, r.metric): r.value for r in report}
    assert len(got) == 9 and got["CC", "formality"] > 0.5 and abs(got["ALL", "embedding"] - 0.5**0.5) < 1e-9
    assert got["AD", "embedding"] is None and got["AD", "meteor"] == 0.0 and F is not None
