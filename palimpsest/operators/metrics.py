"""Detection metrics from counts, and summaries of per-row scores.

Every metric is one hash aggregate over the predictions (map-side combined), then arithmetic on
one row per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def _cells(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    """Counts of the four outcomes and of all rows; a row whose label or prediction is neither 0 nor 1 is in ``n`` only."""
    y, p = F.col(truth), F.col(pred)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def binary_metrics(df: DataFrame, truth: str = "y", pred: str = "yhat", by: list[str] | None = None) -> DataFrame:
    """Accuracy, MCC, and recall, precision and F1 for class 1 and class 0. Rows without a 0/1 label or prediction count as wrong."""
    by = by or []
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rates = _cells(df, truth, pred, by).select(
        *by,
        _ratio(tp + tn, F.col("n")).alias("accuracy"), _mcc(tp, tn, fp, fn).alias("mcc"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(tn, tn + fp).alias("recall_0"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tn, tn + fn).alias("precision_0"))
    return rates.select(
        "*", _f1(F.col("precision"), F.col("recall")).alias("f1"),
        _f1(F.col("precision_0"), F.col("recall_0")).alias("f1_0"))


def _mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return _ratio(tp * tn - fp * fn, spread)


def mcc(df: DataFrame, truth: str = "y", pred: str = "yhat", by: list[str] | None = None) -> DataFrame:
    by = by or []
    cells = _cells(df, truth, pred, by)
    return cells.select(*by, _mcc(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))).alias("mcc"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction.

    Works on the confusion counts: each cell adds to its true class and to its predicted class.
    """
    cells = confusion(df, truth, pred)
    both = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("hit")))
    totals = (cells.select(F.inline(both)).groupBy("class")
              .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")))
    rates = totals.select("class", "support", "hit", _ratio(F.col("hit"), F.col("guessed")).alias("precision"),
                          _ratio(F.col("hit"), F.col("support")).alias("recall"))
    return rates.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def weighted_metrics(df: DataFrame, truth: str = "y", pred: str = "yhat") -> DataFrame:
    """Accuracy, and recall, precision and F1 weighted by class support."""
    n = F.sum("support")
    mean = {m: _ratio(F.sum(F.col(m) * F.col("support")), n).alias(m) for m in ("recall", "precision", "f1")}
    return per_class(df, truth, pred).agg(_ratio(F.sum("hit"), n).alias("accuracy"), *mean.values())


def classification_report(df: DataFrame, truth: str = "y", pred: str = "yhat") -> DataFrame:
    """One row per class, then accuracy, macro average and weighted average."""
    classes = per_class(df, truth, pred)
    n = F.sum("support")
    means = classes.agg(
        n.alias("support"), _ratio(F.sum("hit"), n).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(m) * F.col("support")), n).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])

    def line(row: str, *cells: str) -> Column:
        return F.struct(F.lit(row).alias("row"), *[F.col(c).alias(m) for c, m in zip(cells, ("precision", "recall", "f1"))],
                        F.col("support").alias("support"))

    lines = F.array(line("accuracy", "accuracy", "accuracy", "accuracy"),
                    line("macro avg", "macro_precision", "macro_recall", "macro_f1"),
                    line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"))
    return classes.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support").unionByName(
        means.select(F.inline(lines)))


def _number(score: str) -> Column:
    """NaN as null, because avg passes NaN on."""
    return F.when(~F.isnan(score), F.col(score))


def metric_summary(df: DataFrame, scores: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of each score."""
    cells = [a for s in scores for a in (F.avg(_number(s)).alias(f"{s}_mean"), F.stddev_pop(_number(s)).alias(f"{s}_std"))]
    return df.groupBy(*(by or [])).agg(*cells)


LABEL_GROUPS = {0: "CC", 1: "AD"}


def metric_by_class(df: DataFrame, scores: list[str], by: list[str], label: str = "label") -> DataFrame:
    """Long table: mean and deviation of each score over all rows and per label."""
    grouped = df.groupingSets([[*map(F.col, by)], [*map(F.col, [*by, label])]], *by, label).agg(
        F.grouping_id().alias("_all"),
        *[a for s in scores for a in (F.avg(_number(s)).alias(f"{s}#mean"), F.stddev_pop(_number(s)).alias(f"{s}#std"))])
    names = reduce(lambda c, kv: c.when(F.col(label) == kv[0], F.lit(kv[1])), LABEL_GROUPS.items(),
                   F.when(F.col("_all") > 0, F.lit("ALL")))
    cells = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(f"{s}#mean").alias("value"), F.col(f"{s}#std").alias("std"))
                      for s in scores])
    return (grouped.withColumn("label_group", names).where("label_group IS NOT NULL")
            .select(*by, "label_group", F.inline(cells)))


# Moments: what a report needs to take in new rows without the old ones.

def metric_moments(df: DataFrame, scores: list[str], by: list[str], label: str = "label") -> DataFrame:
    """Long table (by…, label_group, metric, n, mean, m2) over all rows and per label; m2 is the sum of squared differences from the mean."""
    grouped = df.groupingSets([[*map(F.col, by)], [*map(F.col, [*by, label])]], *by, label).agg(
        F.grouping_id().alias("_all"),
        *[a for s in scores for a in (F.count(_number(s)).alias(f"{s}#n"), F.avg(_number(s)).alias(f"{s}#mean"), F.var_pop(_number(s)).alias(f"{s}#var"))])
    names = reduce(lambda c, kv: c.when(F.col(label) == kv[0], F.lit(kv[1])), LABEL_GROUPS.items(), F.when(F.col("_all") > 0, F.lit("ALL")))
    cells = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(f"{s}#n").alias("n"), F.col(f"{s}#mean").alias("mean"), (F.col(f"{s}#var") * F.col(f"{s}#n")).alias("m2")) for s in scores])
    return grouped.withColumn("label_group", names).where("label_group IS NOT NULL").select(*by, "label_group", F.inline(cells))


def merge_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group and metric of moments of disjoint rows, in any number and order; groups without values keep n = 0."""
    keys = [*by, "label_group", "metric"]
    whole = moments.groupBy(*keys).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    same = reduce(lambda a, b: a & b, [F.col(f"m.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys])
    met = moments.alias("m").join(whole.alias("w"), same).select(*[F.col(f"m.{k}").alias(k) for k in keys], "_n", "_mean", "n", "mean", "m2")
    spread = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)
    return met.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), spread.alias("m2"))


def moments_report(moments: DataFrame, by: list[str]) -> DataFrame:
    """Merged moments as the long rows of metric_by_class()."""
    std = F.sqrt(F.try_divide(F.col("m2"), F.col("n").cast("double")))
    return moments.select(*by, "label_group", "metric", F.col("mean").alias("value"), std.alias("std"))


def two_level_mean(df: DataFrame, score: str, group: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the group means."""
    by = by or []
    inner = df.groupBy(*by, group).agg(F.avg(_number(score)).alias("_mean"))
    return inner.groupBy(*by).agg(F.avg("_mean").alias(f"{score}_mean"), F.count("_mean").alias("groups"))


def edit_rates(df: DataFrame, ops: str, by: list[str] | None = None) -> DataFrame:
    """Means over rows of S, I and D over the reference length (a mean of ratios)."""
    length = F.col(f"{ops}.ref_words").cast("double")
    cells = {"SUB": "substitutions", "ADD": "insertions", "DEL": "deletions"}
    return df.groupBy(*(by or [])).agg(
        *[F.avg(F.try_divide(F.col(f"{ops}.{field}").cast("double"), length)).alias(name) for name, field in cells.items()])


def corpus_profile(df: DataFrame, levels: list[str], batch_size: int = 32) -> DataFrame:
    """Row and batch counts for every level of a rollup; a null level stands for all of it."""
    return df.rollup(*levels).agg(F.count("*").alias("rows")).withColumn(
        "batches", F.ceil(F.col("rows") / F.lit(batch_size)).cast("long"))
