"""From raw documents to token files: the stages in order, each written as Parquet and read again by the next.

1. language: drop documents without a language (no text, no letter or no model); a text in several languages stays.
2. near duplicates: of each group of documents linked by similar word shingles, the one with the smallest id stays.
3. contamination: drop documents of whose words a twentieth or more are hit by benchmark windows.
4. mixing: documents as often as the target weights of their sources ask; the last one of a source may be cut.
5. token ids: encode, write token files, read them back; one row per document in the files.

Stages 1 to 4 return the columns of documents, whatever further columns are there. Decisions are tables of ids. Where ids are
null or repeated, the rows are numbered and stored first, and decisions go by number: every row is then a document of
its own, and of a group of near duplicates the first row stays. Null and empty texts have no language and go in stage 1;
stages 2 to 4 on their own keep, keep and drop them (a text without words fills no target). Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import binary_ids, contamination, jaccard, language, mixing
from palimpsest.llm.tables import few, lean
from palimpsest.workspace import remove, stored, tracked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SMALL = 500_000
ROWS = "250"  # of an Arrow batch: five stages in one session leave less room than one operator alone


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of their own, and its name: the id, or a number where ids are null or repeated."""
    lean(docs.sparkSession, ROWS)
    key = "_document"
    while key.lower() in {c.lower() for c in docs.columns}:
        key = f"_{key}"
    n = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if n.rows == n.ids:
        return docs.withColumn(key, F.col("doc_id")), key
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def _named(docs: DataFrame, key: str) -> DataFrame:
    """The documents under their key instead of their id."""
    return docs.drop("doc_id").withColumnRenamed(key, "doc_id")


def _without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    gone = few(stored(ids.select(F.col("doc_id").alias(key)), "dropped"), SMALL)
    return docs.join(gone, key, "left_anti")


_left: list[str] = []  # intermediate tables of the stages before


def tidy(stage: Stage) -> Stage:
    """The stage, after removing the intermediate tables of stages before, which ``docs`` does not read: their results are stored."""
    @wraps(stage)
    def run_tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        gone = [path for path in _left if not any(path in name for name in read)]
        remove(spark, gone)
        with tracked() as made:
            out = stage(spark, docs, sf_dir)
        _left[:] = [path for path in _left if path not in gone] + made
        return out
    return run_tidy


@tidy
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    found = language.label(_named(rows, key), language.train(_named(rows, key)))
    rejected = found.filter(F.col("lang_pred") == language.UNKNOWN)
    return _without(rows, key, rejected).select(docs.columns)


@tidy
def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    groups = jaccard.near_duplicates(_named(rows, key))
    return _without(rows, key, groups.filter("doc_id <> component_id")).select(docs.columns)


@tidy
def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    report = contamination.contamination_report(_named(rows, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, key, report.filter("contaminated")).select(docs.columns)


@tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return mixing.mixed(rows, key).select(docs.columns)


@tidy
def ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lean(spark, ROWS)
    return binary_ids.ids_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("contamination", contamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", ids_stage),
]

#: Stages 1 and 4 to 5 are a trained model, hashes and a tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
