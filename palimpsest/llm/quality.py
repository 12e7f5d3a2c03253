"""Quality rules: counts of each text, base rules, and robust multivariate outliers by language and source.

Counts (``text_counts``). Words are ``[^\\x20\\x09-\\x0D]+``, as written. n_dup_lines: lines (cut at line feeds) that
hold a word and equal an earlier line. n_repeat_words: words inside 3-word windows that the text holds twice or more.

Outliers (``mcd``). Every text that passes the base rules becomes a vector of transformed counts. Each group, (language,
source), gets a minimum-covariance-determinant estimate: concentration steps start from medians and deviations, and each
step keeps the ``share`` of the group's rows that lie nearest by Mahalanobis distance and takes their mean and covariance,
whose determinant never rises. A step is one aggregation of sums over all rows of the table of vectors; the row at the
share is found from exact counts of a fine logarithmic scale of distances, so groups of any size need neither sorting
nor a single task. Groups under ``least`` rows are pooled in their language, and those under it there, in one pool; a
pool under ``least`` rows judges nothing. Rejected: distance, scaled so that its median fits the chi-square
distribution, above the quantile of 1 - ``alpha``.

Deviations are floored (``FLOORS``): a feature that hardly varies in a group cannot reject a text for a trifle.

Defined cases: null and empty texts have zero words and fail the base rules; null language or source is a group of its
own; equal rows are judged alike; empty tables give empty results; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import tokens
from palimpsest.llm.tokens import blocks, windows
from palimpsest.workspace import stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats"]
FLOORS = (0.35, 0.25, 0.15, 0.3, 0.15)
SHARE, LEAST, ALPHA, STEPS = 0.75, 60, 1e-9, 4
SCALE = 32  # steps of the distance scale to each doubling

_SYMBOL = np.isin(tokens.BYTES, list(b"#*$%&|<>"))
_SIZE = np.r_[np.full(128, 1), np.full(64, 0), np.full(64, 1)].astype(np.int64)  # one for the first byte of a character


def _repeated(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For items in order: is the item's (row, hash) there at least twice?"""
    codes, _ = pd.factorize(tokens.mix(h + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return np.bincount(codes, minlength=1)[codes] > 1


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def counts_of(block: tokens.Block) -> dict[str, np.ndarray]:
    n = block.rows
    starts, ends, h, first = block.words(lower=False)
    rows = np.repeat(np.arange(n), np.diff(first))
    chars = np.concatenate([[0], np.cumsum(_SIZE[block.data])])
    out = {"n_words": np.diff(first), "word_chars": _sums(chars[ends] - chars[starts], rows, n)}
    out["n_symbols"] = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])[block.bounds])
    # windows that lie in one text
    w = windows(h, 3)
    inside = rows[:len(w)] == rows[2:] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice = at[_repeated(rows[at], w[at])]
    covered = np.zeros(len(h) + 3, bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = _sums(covered[:len(h)], rows, n)
    # lines with a word; equal lines after the first
    line = np.ones(256, bool)
    line[10] = False
    ls, le = block.spans(line)
    held = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
    ls, le = ls[held], le[held]
    lh = block.word_hashes(ls, le)
    lr = block.owner(ls)
    codes, _ = pd.factorize(tokens.mix(lh + lr.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    new = np.zeros(len(codes), bool)
    new[np.unique(codes, return_index=True)[1]] = True
    out["n_dup_lines"] = _sums(~new, lr, n)
    return out


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of ``text``."""
    kept = [(name, docs.schema[name].dataType.simpleString()) for name in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches):
            got = counts_of(block)
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(kept))] + [pa.array(got[c], pa.int64()) for c in COUNTS], [*keep, *COUNTS])
    schema = ", ".join([f"`{n}` {t}" for n, t in kept] + [f"{c} long" for c in COUNTS])
    return docs.select(*keep, "text").mapInArrow(count, schema)


def base_failed():
    """Under 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumn("v", F.array(
        F.log(words.cast("double")), F.col("word_chars") / words, F.log1p(F.lit(20.0) * F.col("n_symbols") / words),
        F.log1p(F.col("n_dup_lines").cast("double")), F.lit(2.0) * F.col("n_repeat_words") / words))


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Add ``g``: the group that judges the row."""
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.struct(F.lit("source").alias("kind"), "lang", "source")
    pooled = by_source.withColumn("small", F.when(F.col("n") < least, F.col("n")))
    in_lang = F.sum("small").over(Window.partitionBy("lang"))
    nothing = F.lit(None).cast("string")
    g = (F.when(F.col("small").isNull(), own)
         .when(in_lang >= least, F.struct(F.lit("lang").alias("kind"), "lang", nothing.alias("source")))
         .otherwise(F.struct(F.lit("rest").alias("kind"), nothing.alias("lang"), nothing.alias("source"))))
    groups = pooled.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.to_json(g, {"ignoreNullFields": "false"}).alias("g"))
    return (rows.join(groups, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
            .drop("of_lang", "of_source"))


def _distance(p: int):
    """Squared Mahalanobis distance of v to (mean, inverse)."""
    d = [F.col("v")[i] - F.col("mean")[i] for i in range(p)]
    return sum(F.col("inverse")[i * p + j] * d[i] * d[j] for i in range(p) for j in range(p))


def _bin(d2):
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * SCALE).cast("int")


def _fit(sums: DataFrame, p: int) -> DataFrame:
    """Mean and inverse covariance from n, sums and sums of products; one row a group."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, mean = row["n"], np.array(row["s"]) / max(row["n"], 1)
                cov = np.array(row["ss"]).reshape(p, p) / max(n, 1) - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 0, None))
                scale = np.maximum(sd, FLOORS[:p])
                corr = cov / np.outer(scale, scale)  # a floored feature keeps less correlation
                corr[np.diag_indices(p)] = 1.0
                out.append({"g": row["g"], "mean": mean.tolist(), "inverse": (np.linalg.inv(0.98 * corr + 0.02 * np.eye(p)) / np.outer(scale, scale)).ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))]))
    return sums.mapInArrow(fit, "g string, mean array<double>, inverse array<double>")


def _moments(rows: DataFrame, p: int) -> DataFrame:
    v = F.col("v")
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.sum(v[i]) for i in range(p)]).alias("s"),
                                 F.array(*[F.sum(v[i] * v[j]) for i in range(p) for j in range(p)]).alias("ss"))


def _at_share(rows: DataFrame, share: float) -> DataFrame:
    """The step of the distance scale that holds the row at ``share`` of each group, from counts of all rows."""
    steps = rows.groupBy("g", "bin").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    of_all = F.sum("n").over(Window.partitionBy("g"))
    return (steps.withColumn("reached", so_far >= F.ceil(of_all * share)).filter("reached")
            .groupBy("g").agg(F.min("bin").alias("most")))


def _start(rows: DataFrame, p: int, share: float) -> DataFrame:
    """Centre and scales of the first step: per feature, the shortest-way quantiles from counts on a fine grid."""
    grid = rows.select("g", F.posexplode("v").alias("i", "x")).withColumn("bin", F.floor(F.col("x") * 64))
    cells = grid.groupBy("g", "i", "bin").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("g", "i").orderBy("bin"))
    of_all = F.sum("n").over(Window.partitionBy("g", "i"))
    at = cells.withColumn("c", so_far / of_all)
    q = lambda x: F.min(F.when(F.col("c") >= x, F.col("bin"))) / 64.0
    floors = F.array(*[F.lit(float(f)) for f in FLOORS[:p]])
    per = at.groupBy("g", "i").agg(q(0.5).alias("mid"), ((q(0.75) - q(0.25)) / 1.349).alias("sd"))
    per = per.withColumn("sd", F.greatest("sd", floors[F.col("i")]))
    both = per.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "mid", "sd"))).alias("f"))  # p entries
    inverse = F.flatten(F.transform("f", lambda a: F.transform("f", lambda b: F.when(a.i == b.i, 1 / (a.sd * a.sd)).otherwise(0.0))))
    return both.select("g", F.transform("f", lambda a: a.mid).alias("mean"), inverse.alias("inverse"))


def mcd(rows: DataFrame, share: float = SHARE, least: int = LEAST, alpha: float = ALPHA, steps: int = STEPS) -> DataFrame:
    """``rows`` (lang, source, v, ...) with d2 (scaled squared distance; null if not judged) and outlier."""
    p = len(FEATURES)
    grouped = stored(_grouped(rows, least), "quality-vectors")
    vectors = grouped.select("g", "v")
    model = _start(vectors, p, share)
    for step in range(steps):
        model = stored(model, "quality-model")
        near = vectors.join(model, "g").withColumn("bin", _bin(_distance(p)))
        cut = _at_share(near, share)
        inside = near.select("g", "v", "bin").join(cut, "g").filter("bin <= most")
        model = _fit(_moments(inside, p), p)
    model = stored(model, "quality-model")
    half = _at_share(vectors.join(model, "g").withColumn("bin", _bin(_distance(p))), 0.5)
    size = vectors.groupBy("g").agg(F.count("*").alias("n"))
    scale = stored(model.join(half, "g").join(size, "g").withColumn("half", F.pow(F.lit(2.0), (F.col("most") + 1) / SCALE)).drop("most"), "quality-scale")
    middle, top = chi_square(0.5, p), chi_square(1 - alpha, p)
    d2 = F.when(F.col("n") >= least, _distance(p) / F.greatest(F.col("half") / middle, F.lit(1.0)))
    judged = grouped.join(scale, "g").withColumn("d2", d2)
    return judged.withColumn("outlier", F.coalesce(F.col("d2") > top, F.lit(False))).drop("mean", "inverse", "half", "n", "g")


def chi_square(q: float, p: int) -> float:
    """Quantile of the chi-square distribution, by bisection of a numeric integral (driver, a few numbers)."""
    from math import gamma

    low, high = 0.0, 400.0
    for _ in range(60):
        x = (low + high) / 2
        t = (np.arange(4000) + 0.5) * (x ** 0.5) / 4000  # substitute u = t^2 to tame the start
        part = float(np.sum(2 * t ** (p - 1) * np.exp(-t * t / 2)) * (x ** 0.5) / 4000) / (2 ** (p / 2) * gamma(p / 2))
        low, high = (x, high) if part < q else (low, x)
    return low


def judged(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and d2 for every row of (doc_id, text, lang, source)."""
    rows = stored(text_counts(docs, "doc_id", "lang", "source").withColumn("base_failed", base_failed()), "quality-counts")
    passing = mcd(features(rows.filter("not base_failed")), **options)
    columns = ["doc_id", *COUNTS, "base_failed"]
    good = passing.select(*columns, (~F.col("outlier")).alias("kept"), "d2")
    return good.unionByName(rows.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2")))
