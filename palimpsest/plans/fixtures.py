"""Views over the given tables that stand in for rewritten-text corpora.

Conversations give pairs (a turn and the answer to it), labelled documents give sentences and
classifier input, events give training logs, pages give trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.answers import GEMMA, LLAMA3, MISTRAL, PHI3
from palimpsest.operators.documents import split_sentences
from palimpsest.operators.numbering import next_in_sequence, row_ids


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(out, TEXT_TABLES[name]) if name in TEXT_TABLES else out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the session has cores.

    For work that is heavy per row. A table of many files has more splits than cores and is left
    alone, so this shuffle does not occur at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_id, text, adv_text, label): a user turn and the answer that follows it."""
    turns = next_in_sequence(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"])
    return turns.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "text", F.col("next_text").alias("adv_text"),
        (F.col("conv_id") % 2).cast("int").alias("label"))


def pairs_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = F.col("doc_id") * 31 + F.col("sent_id")
    return pairs(spark, sf_dir).select(
        "doc_id", "sent_id", F.when(mix % 13 != 0, F.col("text")).alias("text"),
        F.when(mix % 11 != 0, F.col("adv_text")).alias("adv_text"), "label")


SYSTEMS = (PHI3, MISTRAL, GEMMA, LLAMA3)
SETTINGS = ("ZS", "FS", "KB")


def raw_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every system and setting with one of six wrapper shapes around the answer."""
    shape = (F.col("doc_id") + F.col("sent_id")) % 6
    text, adv = F.col("text"), F.col("adv_text")
    raw = (F.when(shape == 0, F.concat(F.lit('"Output: '), adv, F.lit('" (note) [x]')))
           .when(shape == 1, F.concat(F.lit("Dementia: "), text, F.lit(" Healthy: "), adv))
           .when(shape == 2, F.concat(F.lit("Output sentence:"), adv, F.lit("; more")))
           .when(shape == 3, F.concat(F.lit("**Rewrite:** "), adv))
           .when(shape == 4, F.concat(F.lit("'"), adv)).otherwise(F.lit("")))
    runs = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("setting")) for s in SYSTEMS for k in SETTINGS])
    return pairs(spark, sf_dir).select("doc_id", "sent_id", raw.alias("raw_text"), F.inline(runs))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label; both tables have one row per document."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, sent_id, text)"""
    docs = labelled_documents(spark, sf_dir).select("doc_id", F.col("quality").alias("label"), "text")
    return split_sentences(docs, ["doc_id", "label"], "text")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).select(
        "doc_id", "lang", "source", "text", F.col("quality").alias("label"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and a fixed prediction: long documents are class 1."""
    return labelled_documents(spark, sf_dir).select(
        "doc_id", "lang", "source", F.col("quality").alias("y"),
        F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("yhat"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).select(
        F.col("source").alias("model"), F.col("lang").alias("dataset"),
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("temperature"),
        F.when(F.col("y") == F.col("yhat"), 1.0).otherwise(0.0).alias("hit"), "doc_id")
    return rows.groupBy("model", "dataset", "temperature").agg(
        F.avg("hit").alias("value"), (F.max("doc_id") % 2).alias("version")).select(
        "model", "dataset", "temperature", F.lit("SVM").alias("classifier"), F.lit("accuracy").alias("metric"),
        "value", "version")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one."""
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return vectors.select("vec_id", "label", F.col("embedding").alias("e1")).join(after, "vec_id")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits"))


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user: its events in time order."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    placed = row_ids(events, ["user_id"], ["ts", "event_id"], within="pos")
    return placed.select(F.col("user_id").alias("run_id"), (F.col("pos") + 1).alias("step"),
                         F.col("value").alias("val_loss"))
