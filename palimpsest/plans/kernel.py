"""Support vector machine with a Gaussian kernel, by random Fourier features.

z_j(x) = sqrt(2 / D) cos(w_j · x + b_j), with normal w_j, has z(x) · z(y) near exp(-gamma |x - y|²), closer with more features (the error is about
1 / sqrt(D)). The numbers w_j are made where they are needed, from a hash of the term's number and j, so no matrix travels or is stored. What
is left is a linear fit on D features (``linear``), whose D + 1 weights are the model beside the terms.

Texts are TF-IDF rows as in ``term_blocks``. Without a gamma it is one over the number of terms times the variance of all cells. Defined cases: as in ``text_models``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.skew import salted_lookup
from palimpsest.operators.term_blocks import BLOCK, INTERCEPT, Matrix, TermBlocks, numbered_rows, pack_cells, row_terms
from palimpsest.plans.forest import hashed
from palimpsest.plans.linear import Problem, fit_linear
from palimpsest.plans.text_models import ALL, TFIDF_COST, training_blocks
from palimpsest.workspace import stored

FEATURES, SEED, STEP, CELLS = 512, 42, 64, 50_000


def projections(m: Matrix, gamma: float, size: int, seed: int) -> np.ndarray:
    """The features z of every row of a block: one line a row."""
    real = m.ids != INTERCEPT
    out = np.empty((len(m.rows), size))
    cuts = [0, *(np.flatnonzero(np.diff(m.starts[:-1] // CELLS)) + 1).tolist(), len(m.rows)]  # some rows at a time: their products take 512 bytes an entry
    for a in range(0, size, STEP):
        j = np.arange(a, min(a + STEP, size))
        # two uniform numbers of a hash give one normal number
        u, v = (hashed(seed + k, m.ids[:, None], j[None, :]) for k in (0, 1))
        w = np.sqrt(-2 * np.log(np.maximum(u, 2.0**-60))) * np.cos(2 * np.pi * v) * real[:, None]
        sums = np.empty((len(m.rows), len(j)))
        for first, last in zip(cuts, cuts[1:]):
            at = slice(m.starts[first], m.starts[last])
            sums[first:last] = np.add.reduceat(m.vals[at, None] * w[m.cols[at]], m.starts[first:last] - at.start, axis=0)
        out[:, j] = np.cos(np.sqrt(2 * gamma) * sums + 2 * np.pi * hashed(seed + 2, j)[None, :])
    return np.sqrt(2 / size) * out


def scale_gamma(data: TermBlocks) -> float:
    """1 / (terms * variance of all cells) of the one set."""
    def add(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = Matrix(row)
                x = m.vals[m.ids[m.cols] != INTERCEPT]
                yield pa.RecordBatch.from_arrays([pa.array([float(x.sum())]), pa.array([float(x @ x)]), pa.array([len(m.rows)], pa.int64())], ["s", "q", "n"])
    r = data.blocks.mapInArrow(add, "s double, q double, n long").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).first()
    terms = data.terms.count()
    cells = terms * (r.n or 0)
    spread = r.q / cells - (r.s / cells) ** 2 if cells else 0.0
    return 1 / (terms * spread) if spread > 0 else 1.0


@dataclass(frozen=True)
class KernelModel:
    terms: DataFrame  # (term, term_id, idf)
    weights: tuple[float, ...]  # of the features, and the intercept
    gamma: float
    seed: int
    gap: float


def _dense(gamma: float, size: int, seed: int):
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = Matrix(row)
                n = len(m.rows)
                vals = np.hstack([projections(m, gamma, size, seed), np.ones((n, 1))])
                ids = np.append(np.arange(size), INTERCEPT)
                order = np.argsort(ids)  # ids of a block are sorted
                arrays = [m.rows.astype("<i8"), m.labels.astype("<f8"), (np.arange(n + 1) * (size + 1)).astype("<i8"), ids[order].astype("<i8"), np.tile(np.arange(size + 1), n).astype("<i4"), vals[:, order].astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([row["set"]]), pa.array([row["block"]], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["set", "block", "rows", "labels", "starts", "ids", "cols", "vals"])
    return work


def fit_kernel(train: DataFrame, text: str = "text", label: str = "label", features: int = FEATURES, cost: float = TFIDF_COST, gamma: float | None = None, seed: int = SEED) -> KernelModel:
    data = training_blocks(train, "TFIDF", text, label)
    gamma = gamma or scale_gamma(data)
    blocks = stored(data.blocks.mapInArrow(_dense(gamma, features, seed), BLOCK), "kernel-blocks")
    columns = F.explode(F.sequence(F.lit(INTERCEPT).cast("long"), F.lit(features - 1).cast("long")))
    uses = stored(blocks.select("set", "block", columns.alias("term_id")), "kernel-uses")  # every block has all columns
    fit = fit_linear(TermBlocks(data.terms, blocks, uses, data.sizes), [Problem(ALL, "hinge", cost)])
    weights = np.zeros(features + 1)
    for r in fit.weights.collect():  # D + 1 numbers
        weights[r.term_id] = r.value  # the intercept, -1, is the last
    return KernelModel(data.terms.select("term", "term_id", "idf"), tuple(weights.tolist()), gamma, seed, max(fit.gaps.values(), default=0.0))


def predict_kernel(model: KernelModel, df: DataFrame, text: str = "text", rows: int = 2000) -> DataFrame:
    """The columns of ``df`` but the text, with pred (0 or 1) and the margin as score."""
    keys = [c for c in df.columns if c != text]
    asked = numbered_rows(df.select(*keys, F.coalesce(text, F.lit("")).alias("_text")), "row_id")
    known = salted_lookup(row_terms(asked, ["row_id"], tokens(F.col("_text"))), model.terms, ["term"], ["row_id"], large=True)
    cells = known.select("row_id", "term_id", (F.col("tf") * F.col("idf")).alias("value")).unionByName(asked.select("row_id", F.lit(INTERCEPT).cast("long").alias("term_id"), F.lit(1.0).alias("value")))
    blocks = max(1, -(-asked.count() // rows))
    dealt = cells.select(F.lit(ALL).alias("set"), F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("block"), "row_id", "term_id", "value", F.lit(0.0).alias("label"))
    w, gamma, seed = np.array(model.weights), model.gamma, model.seed
    pack = pack_cells(True)

    def score(group: pa.Table) -> pa.Table:
        m = Matrix(pack(group).to_pylist()[0])
        margin = projections(m, gamma, len(w) - 1, seed) @ w[:-1] + w[-1]
        return pa.table([pa.array(m.rows), pa.array((margin > 0).astype(np.int32)), pa.array(margin)], ["row_id", "pred", "score"])
    scored = dealt.groupBy("set", "block").applyInArrow(score, "row_id long, pred int, score double")
    return asked.drop("_text").join(scored, "row_id").drop("row_id")
