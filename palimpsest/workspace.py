"""Shared scratch space and checkpoints.

Everything written between stages goes under the folder the cluster names in
``spark.checkpoint.dir``, which every executor can reach. A machine-local folder
is used only by a local session that names none (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


_tracks: list[list[str]] = []


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/palimpsest/{purpose}-{uuid.uuid4().hex}"
    for made in _tracks:
        made.append(path)
    return path


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths that fresh_path() gives inside, for a caller who knows when they are no longer read."""
    made: list[str] = []
    _tracks.append(made)
    try:
        yield made
    finally:
        _tracks[:] = [t for t in _tracks if t is not made]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths that fresh_path() gave."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
