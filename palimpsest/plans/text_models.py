"""Text classifiers for many training sets at once: one count of terms, one fit for all sets and classifiers, one pass over what is scored.

No term is hashed or left out. ``SVM`` and ``LR`` are linear (``linear``), ``RF`` a forest (``forest``). Training texts carry the sets that they
belong to; texts to score carry the sets whose models they are asked of. Models are tables: (set, term, idf, weights by classifier), intercepts, and the forests' nodes.

Defined cases: null texts are empty; rows without a label are not learnt from; a set without rows has no model, and texts asked of it
get no rows; a set of one class predicts it; unknown terms count nothing; a text without known terms is judged by the intercept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import tokens
from palimpsest.operators.skew import by_shuffle, salted_lookup
from palimpsest.operators.term_blocks import INTERCEPT, TermBlocks, numbered_rows, row_terms, term_blocks
from palimpsest.plans.forest import TREES, ask, fit_forests
from palimpsest.plans.linear import Problem, fit_linear
from palimpsest.workspace import stored

BOW_COST = 0.016763776584841045   # fixed value: cost of a margin violation with term counts
TFIDF_COST, SHRINK = 1.0, 0.01
CLASSIFIERS = ("SVM", "RF", "LR")
LOSSES = {"SVM": "hinge", "LR": "logistic"}
ALL = "all"  # the set's name where there is one only
_NODES = "set string, tree int, node int, term string, probability double"


def linear_cost(classifier: str, feature: str, rows: int) -> float:
    """The cost C of ½ w·w + C Σ loss; for LR the mean loss has weight 1 against SHRINK / 2 w·w."""
    if classifier == "LR":
        return 1.0 / (SHRINK * max(rows, 1))
    return BOW_COST if feature == "BOW" else TFIDF_COST


@dataclass(frozen=True)
class TextModels:
    feature: str
    classifiers: tuple[str, ...]
    terms: DataFrame  # (set, term, idf, weights map<classifier, double>)
    intercepts: DataFrame  # (set, weights map<classifier, double>): a row a set
    nodes: DataFrame  # (set, tree, node, term, probability): at most trees x 2^depth a set

    def save(self, path: str) -> None:
        for name in ("terms", "intercepts", "nodes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        about = self.terms.sparkSession.createDataFrame([(self.feature, list(self.classifiers))], "feature string, classifiers array<string>")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextModels:
        about = spark.read.parquet(f"{path}/about").first()
        return TextModels(about.feature, tuple(about.classifiers), *(spark.read.parquet(f"{path}/{name}") for name in ("terms", "intercepts", "nodes")))


def training_blocks(train: DataFrame, feature: str = "TFIDF", text: str = "text", label: str = "label", sets: str | None = None) -> TermBlocks:
    of = F.col(sets) if sets else F.array(F.lit(ALL))
    rows = train.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), of.alias("sets"), F.coalesce(text, F.lit("")).alias("text"))
    return term_blocks(numbered_rows(rows), tokens(F.col("text")), feature)


def problems_of(data: TermBlocks, classifiers: list[str], feature: str) -> list[Problem]:
    return [Problem(s, LOSSES[c], linear_cost(c, feature, n)) for s, (n, _) in data.sizes.items() for c in classifiers if c in LOSSES]


def fit_many(train: DataFrame, classifiers: list[str], feature: str = "TFIDF", text: str = "text", label: str = "label", sets: str | None = None) -> TextModels:
    """Every classifier on every training set; ``sets`` names the column (array) of the sets that a row belongs to, one set if there is none."""
    unknown = set(classifiers) - set(CLASSIFIERS)
    if unknown:
        raise ValueError(f"classifiers must be of {CLASSIFIERS}, not {sorted(unknown)}")
    data = training_blocks(train, feature, text, label, sets)
    spark = data.blocks.sparkSession
    fit = fit_linear(data, problems_of(data, classifiers, feature))
    name = F.create_map(*[F.lit(x) for c, loss in LOSSES.items() for x in (loss, c)])
    by_term = fit.weights.groupBy("set", "term_id").agg(F.map_from_entries(F.collect_list(F.struct(name[F.col("loss")], "value"))).alias("weights"))
    terms = stored(data.terms.join(by_shuffle(by_term), ["set", "term_id"], "left").select("set", "term", "idf", "weights"), "models")
    none = spark.createDataFrame([(s,) for s in data.sizes], "set string")
    intercepts = stored(none.join(by_term.filter(F.col("term_id") == INTERCEPT), "set", "left").select("set", "weights"), "models")
    grown = fit_forests(data, list(data.sizes)) if "RF" in classifiers else {}
    flat = [(s, t, k, x.term_id, x.probability) for s, forest in grown.items() for (t, k), x in forest.items()]
    nodes = spark.createDataFrame(flat, "set string, tree int, node int, term_id long, probability double")
    asked = F.broadcast(nodes.select("set", "term_id").where("term_id IS NOT NULL").distinct())  # at most trees x 2^depth a set
    named = data.terms.select("set", "term_id", "term").join(asked, ["set", "term_id"])
    nodes = stored(nodes.join(named, ["set", "term_id"], "left").select("set", "tree", "node", "term", "probability"), "models")
    return TextModels(feature, tuple(classifiers), terms, intercepts, nodes)


def predict_many(models: TextModels, df: DataFrame, text: str = "text", sets: str | None = None) -> DataFrame:
    """The columns of ``df`` but text and sets, with set, classifier, pred (0 or 1) and score, for each model that a row is asked of.

    The score is the probability of class 1 (RF, LR) or the margin (SVM).
    """
    of = F.col(sets) if sets else F.array(F.lit(ALL))
    keys = [c for c in df.columns if c not in (text, sets)]
    rows = numbered_rows(df.select(*keys, of.alias("_sets"), F.coalesce(text, F.lit("")).alias("_text")), "_row")
    trained = [r["set"] for r in models.intercepts.select("set").collect()]  # a row a set
    rows = rows.select(*keys, "_row", "_text", F.explode(F.array_intersect("_sets", F.array(*[F.lit(s) for s in trained]).cast("array<string>"))).alias("set"))
    parts = [_linear(models, rows, keys)] if set(models.classifiers) & LOSSES.keys() else []
    if "RF" in models.classifiers:
        parts.append(_forest(models, rows, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _linear(models: TextModels, rows: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in models.classifiers if c in LOSSES]
    counted = row_terms(rows, ["_row", "set"], tokens(F.col("_text")))
    known = salted_lookup(counted, models.terms, ["set", "term"], ["_row"], large=True)
    value = F.col("tf") * F.col("idf")
    weighted = known.select("_row", "set", (value * value).alias("_square"), *[(value * F.coalesce(F.col("weights")[c], F.lit(0.0))).alias(f"_{c}") for c in names])
    sums = weighted.groupBy("_row", "set").agg(F.sum("_square").alias("_square"), *[F.sum(f"_{c}").alias(f"_{c}") for c in names])
    norm = F.sqrt("_square") if models.feature == "TFIDF" else F.lit(1.0)
    met = rows.drop("_text").join(sums, ["_row", "set"], "left").join(F.broadcast(models.intercepts), "set")  # intercepts: a row a set

    def of(c: str) -> Column:
        margin = F.coalesce(F.try_divide(F.col(f"_{c}"), norm), F.lit(0.0)) + F.coalesce(F.col("weights")[c], F.lit(0.0))
        score = 1 / (1 + F.exp(-margin)) if c == "LR" else margin
        return F.struct(F.lit(c).alias("classifier"), (margin > 0).cast("int").alias("pred"), score.alias("score"))
    return met.select(*keys, "set", F.inline(F.array(*[of(c) for c in names])))


def _forest(models: TextModels, rows: DataFrame, keys: list[str]) -> DataFrame:
    forests: dict[str, dict[tuple[int, int], tuple[str | None, float]]] = {}
    for r in models.nodes.collect():  # trees x 2^depth a set
        forests.setdefault(r["set"], {})[r.tree, r.node] = (r.term, r.probability)
    trees = {s: 1 + max(t for t, _ in forest) for s, forest in forests.items()}

    def judge(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            scores = [ask(forests[s], trees[s], set(words)) for s, words in zip(batch.column(at("set")).to_pylist(), batch.column(at("_tokens")).to_pylist())]
            kept = [batch.column(at(c)) for c in [*keys, "set"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(["RF"] * len(scores), pa.string()), pa.array([int(s > 0.5) for s in scores], pa.int32()), pa.array(scores, pa.float64())],
                                             [*keys, "set", "classifier", "pred", "score"])
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("set", T.StringType()), T.StructField("classifier", T.StringType()), T.StructField("pred", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return rows.select(*keys, "set", F.array_distinct(tokens(F.col("_text"))).alias("_tokens")).mapInArrow(judge, schema)


#: Training texts (text, label, sets) and classifiers to a function from texts (further columns, text, sets) to their predictions.
Learner = Callable[[DataFrame, list[str]], Callable[[DataFrame], DataFrame]]


def learn(train: DataFrame, classifiers: list[str]) -> Callable[[DataFrame], DataFrame]:
    models = fit_many(train, classifiers, sets="sets")
    return lambda df: predict_many(models, df, sets="sets")
