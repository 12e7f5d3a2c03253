"""What the plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.functions import text as tx
from palimpsest.operators import documents as docs
from palimpsest.operators import numbering as num
from palimpsest.operators import training_log as tl
from palimpsest.operators import vocabulary as voc
from palimpsest.operators.skew import default_salts, hot_keys, salted_copies, salted_lookup
from palimpsest.plans import q_measures, q_models

SF = "/root/testdata/sf0.001"
PLANNED = ["quality_report", "tfidf", "tfidf_cosine", "perplexity", "embedding_cosine", "lexical_overlap", "bow_counts", "row_ids",
           "head_fraction", "split_batches", "render_prompt", "run_grid", "pair_sides", "clean_generated", "bleu_n", "early_stopping"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big_sides(spark):
    """Plans as they are for sides too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_products(spark, big_sides, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_lookups_are_shuffled_by_key_and_salt(spark, big_sides):
    text = spark.createDataFrame([(1, "aa bb")], "id long, t string")
    found = plan(voc.tfidf(text, text, ["id"], tx.tokens(F.col("t"))))
    assert found.count("hashpartitioning(term") >= 3 and found.count("_salt") >= 2


def test_salts_spread_one_hot_key(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1.0)], "k string, v double")
    salted = salted_lookup(rows, lookup, ["k"], ["id"], salts=16)
    assert salted.count() == 4000 and salted.columns == ["k", "id", "v"]
    parts = rows.select(F.xxhash64("id").bitwiseAND(F.lit(15)).alias("s")).groupBy("s").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 400
    assert default_salts(rows) == 2   # eight shuffle partitions


def test_only_hot_keys_of_a_lookup_are_copied(spark):
    lookup = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("k"), F.col("id").alias("v"))
    hot = F.when(F.col("id") % 4 == 0, F.lit("w7")).otherwise(F.concat(F.lit("w"), F.col("id") % 20_500))
    rows = spark.range(60_000).select(F.when(F.col("id") % 1000 != 1, hot).alias("k"), "id")   # w7 hot, some keys unknown, some null
    assert [r.k for r in hot_keys(rows, ["k"], ["id"]).collect()] == ["w7"]
    copies = salted_copies(lookup, hot_keys(rows, ["k"], ["id"]), ["k"], 16)
    assert copies.count() == 20_000 + 15 and copies.columns == ["k", "v", "_salt"]
    plain = lambda how: sorted(map(str, rows.join(lookup, "k", how).collect()))
    for how in ("inner", "left", "left_anti"):
        assert sorted(map(str, salted_lookup(rows, lookup, ["k"], ["id"], how, salts=16).collect())) == plain(how)


def test_stored_vocabularies_are_not_broadcast(spark):
    from palimpsest.plans import text_models as tm

    rows = [(i, f"w{i} w{i + 1} all", i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    models = tm.fit_many(train, ["LR", "RF"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        asked, splits = plan(tm.predict_many(models, train)), plan(q_models.term_splits(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in asked.split("\n") if "BroadcastHashJoin" in line]
    assert joins and not any("_salt" in line for line in joins)   # hot keys and intercepts alone
    scored = tm.predict_many(models, train).groupBy("classifier").count().collect()
    assert sorted((r.classifier, r["count"]) for r in scored) == [("LR", 40), ("RF", 40)]
    assert models.nodes.where("term IS NOT NULL").count() and models.nodes.where("term IS NULL").count()
    assert not any("[term_id" in line for line in splits.split("\n") if "BroadcastHashJoin" in line)


def test_rewrites_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "I I um said, so-so said")], "doc_id long, text string")
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized(docs.select(tx.disfluency_rewrite(F.col("text")).alias("r"))).count("regexp_extract_all") == 1
    runs = q_models._knobs(docs)
    assert optimized(runs).count("regexp_extract_all") == 1
    assert "regexp_extract_all" not in optimized(runs.select("system", "temperature").distinct())   # the knobs alone
    assert runs.columns == ["doc_id", "text", "system", "temperature", "adv_text"]
    once = docs.select(tx.disfluency_rewrite(F.col("text"))).first()[0]
    assert [(r.temperature, r.adv_text) for r in runs.orderBy("temperature").collect()] == [("t0", once), ("t1", once.lower())]
    assert optimized(q_measures.knob_pairs(spark, SF)).count("regexp_extract_all") == 1


def test_exchanges_are_shared(spark, big_sides):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(entry.queries()["tfidf_cosine"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    lines = [line for line in text.split("\n") if "ReusedExchange" in line and "term#" in line]
    assert lines, "the (key, term) counts are computed once"


def test_top_n_is_cut_before_the_shuffle(spark):
    log = spark.createDataFrame([(1, 1, 0.5)], "run_id long, step long, val_loss double")
    found = plan(tl.best_n_checkpoints(log, 2))
    assert "row_number(), 2, Partial" in found and "row_number(), 2, Final" in found


def test_long_documents_are_gathered_in_pieces(spark):
    rows = spark.createDataFrame([(1, 1, "a")], "doc long, place long, t string")
    found = plan(docs.assemble_docs(rows, ["doc"], "place", "t"))
    assert "_piece" in found and found.count("Exchange hashpartitioning") == 2


def test_heads_of_chunks_are_filtered_at_the_scan(spark):
    from palimpsest.plans import fixtures
    found = plan(fixtures.pairs(spark, SF))
    assert f"GreaterThanOrEqual(turn,{num.CHUNK})" in found
    assert "url" not in found


def test_only_needed_columns_are_read(spark):
    found = plan(entry.queries()["knob_key"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,props:string>" in found


def test_cleaning_is_not_repeated_below_a_later_filter(spark):
    from palimpsest.functions.answers import clean_generated
    rows = spark.createDataFrame([("a", "b", "c")], "raw string, system string, setting string")
    found = plan(clean_generated(rows, "raw").where(F.length("adv_text") > 3))
    assert found.count("ealthy:") < 40
