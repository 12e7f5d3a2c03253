"""Early stopping and best checkpoints over the validation logs of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.numbering import CHUNK, chunk_of


def early_stopping(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "val_loss",
                   patience: int = 3, width: int = CHUNK) -> DataFrame:
    """Best loss so far, validations since the last strict improvement, and the stop flag.

    A run of any length is cut into chunks of ``width`` steps. Within a chunk the running values
    come from a local window; what earlier chunks add (best loss, number of rows, place of the last
    improvement) comes from one summary row per chunk: the last improvement of a chunk is the first
    row at its least loss, if that beats all earlier chunks. Every row needs a run and a step.
    """
    local = W.partitionBy(run, "_chunk").orderBy(step)
    rows = (log.withColumn("_chunk", chunk_of(step, width)).where(F.col("_chunk").isNotNull() & F.col(run).isNotNull())
            .withColumn("_at", F.row_number().over(local).cast("long"))
            .withColumn("_best", F.min(loss).over(local.rowsBetween(W.unboundedPreceding, -1))))
    summary = rows.groupBy(run, "_chunk").agg(
        F.count("*").alias("_n"), F.min(F.struct(F.col(loss).alias("v"), F.col("_at").alias("at"))).alias("_least"))
    earlier = W.partitionBy(run).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (summary
               .withColumn("_rows", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .withColumn("_floor", F.min("_least.v").over(earlier))
               .withColumn("_place", F.when(F.col("_floor").isNull() | (F.col("_least.v") < F.col("_floor")),
                                            F.col("_rows") + F.col("_least.at")))
               .withColumn("_since", F.max("_place").over(earlier))
               .select(run, "_chunk", "_rows", "_floor", "_since"))
    joined = rows.join(carried, [run, "_chunk"])
    prior = F.least("_best", "_floor")
    better = prior.isNull() | (F.col(loss) < prior)
    placed = joined.withColumn("_row", F.col("_rows") + F.col("_at")).withColumn(
        "_hit", F.when(better, F.col("_row")))
    running = W.partitionBy(run, "_chunk").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    since = F.col("_row") - F.greatest(F.max("_hit").over(running), F.col("_since"))
    return placed.select(
        run, step, loss, F.least(loss, prior).alias("best_loss"), since.cast("long").alias("no_improvement"),
        (since >= patience).alias("stop"))


def best_n_checkpoints(log: DataFrame, n: int, run: str = "run_id", step: str = "step", loss: str = "val_loss") -> DataFrame:
    """The n steps of least loss per run; earlier steps win ties.

    Spark applies the row-number limit before the shuffle too, so a long run sends n rows per task.
    """
    best = W.partitionBy(run).orderBy(loss, step)
    return log.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
