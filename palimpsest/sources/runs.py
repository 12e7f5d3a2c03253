"""Run configurations: JSON maps of systems into one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.schema import RUN_SYSTEM

_MISSING = "None"   # how a missing path or setting is spelt in configurations


def parse_systems(config: Column) -> Column:
    return F.from_json(config, T.MapType(T.StringType(), RUN_SYSTEM))


def merge_systems(base: Column, extra: Column) -> Column:
    """Systems of both maps; where both name one, ``extra`` wins."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def run_grid(configs: DataFrame, config: str, datasets: str, classifiers: list[str]) -> DataFrame:
    """One row per dataset, system, temperature and classifier of each configuration row.

    ``config`` holds the JSON map and ``datasets`` an array of names. A sentence classifier cannot
    score whole documents: such rows are marked not runnable. Missing values become null.
    """
    systems = configs.select(F.col(datasets).alias("_datasets"),
                             F.explode(parse_systems(F.col(config))).alias("system", "_s"))
    known = lambda c: F.when(~c.isin(_MISSING, ""), c)
    knobs = systems.select(
        "_datasets", "system", known(F.col("_s.project_dir")).alias("project_dir"), F.col("_s.level").alias("level"),
        F.coalesce("_s.by_document", F.lit(False)).alias("by_document"),
        F.explode("_s.temperatures").alias("temperature"))
    rows = knobs.select("*", F.explode("_datasets").alias("dataset"))
    grid = rows.select("*", F.explode(F.array(*map(F.lit, classifiers))).alias("classifier"))
    runnable = ~((F.col("level") == "doc") & F.col("classifier").endswith("_sent"))
    return grid.select("dataset", "system", "project_dir", "temperature", "classifier", "level", "by_document",
                       runnable.alias("runnable"))


def knob_from_map(setting: Column) -> Column:
    """A map as the same key that its JSON text without quotes would give: ``{a: 1, b: 2}``."""
    entries = F.transform(F.map_entries(setting), lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
