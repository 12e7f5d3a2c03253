"""Exact term features of training texts, for many training sets at once, packed into blocks of rows.

Every term of the training texts gets a dense id by distributed numbering, and no two terms share one. A text may belong to
several training sets: its terms are counted once, and only weights that depend on the set (IDF) are made per set.

A block is a sparse matrix of some rows of one set: row numbers, labels, term ids and values in binary columns. Rows are dealt to blocks by
a hash of their number, as many blocks as the set's entries ask for, so that a block is some 40 megabytes whatever the set's size. The last
column of every row is the intercept, a term of value 1 with id -1; rows without terms have it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.numbering import number_rows
from palimpsest.operators.skew import by_shuffle, salted_lookup
from palimpsest.workspace import stored

INTERCEPT = -1
BLOCK_ENTRIES = 3_000_000  # some 40 MB packed; fits of one block end in a round, so fewer blocks are better
FEATURES = ("TFIDF", "BOW")
BLOCK = "set string, block int, rows binary, labels binary, starts binary, ids binary, cols binary, vals binary"


@dataclass(frozen=True)
class TermBlocks:
    terms: DataFrame   # (set, term_id, term, df, idf), stored; idf is 1 for plain counts
    blocks: DataFrame  # see BLOCK, stored
    uses: DataFrame | None  # (set, term_id, block): which blocks have which terms; stored; None where every set has one block
    sizes: dict[str, tuple[int, int]]  # rows and blocks of each set


def numbered_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """The rows with a number each, written once so that the numbers stay."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def row_terms(texts: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, term, tf) of each text; the terms of a text are combined before they are dealt."""
    return texts.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def term_dictionary(terms: DataFrame) -> DataFrame:
    """(term, term_id): every distinct term with its place in the order of all."""
    return number_rows(terms.select("term").distinct(), ["term"], "term_id")


def term_blocks(texts: DataFrame, tokens: Column, feature: str = "TFIDF", entries: int = BLOCK_ENTRIES) -> TermBlocks:
    """Blocks of ``texts`` (row_id, label, sets array<string>, text): terms counted once, weighted for each set.

    TFIDF is count * (ln((1 + n) / (1 + df)) + 1), L2-normalised by row; BOW is the plain count.
    """
    if feature not in FEATURES:
        raise ValueError(f"feature must be one of {FEATURES}, not {feature!r}")
    counted = stored(row_terms(texts, ["row_id", "sets"], tokens), "row-terms")
    dictionary = term_dictionary(counted)
    members = texts.select("row_id", F.col("label").cast("double").alias("label"), F.explode("sets").alias("set"))
    totals = {r["set"]: r for r in members.groupBy("set").agg(F.count("*").alias("n")).collect()}  # a row for each training set
    of_set = counted.select(F.explode("sets").alias("set"), "term").groupBy("set", "term").agg(F.count("*").alias("df"))
    n = F.create_map(*[F.lit(x) for s, r in totals.items() for x in (s, r.n)]) if totals else F.lit(None).cast("map<string,bigint>")
    idf = F.log((1 + n[F.col("set")]) / (1 + F.col("df"))) + 1 if feature == "TFIDF" else F.lit(1.0)
    terms = stored(of_set.join(by_shuffle(dictionary), "term").select("set", "term_id", "term", "df", idf.alias("idf")), "set-terms")
    filled = {r["set"]: r.entries for r in terms.groupBy("set").agg(F.sum("df").alias("entries")).collect()}
    sizes = {s: (r.n, max(1, -(-(filled.get(s, 0) + r.n) // entries))) for s, r in totals.items()}
    parts = F.create_map(*[F.lit(x) for s, (_, k) in sizes.items() for x in (s, k)]) if sizes else F.lit(None).cast("map<string,int>")
    block = F.pmod(F.xxhash64("row_id"), parts[F.col("set")]).cast("int")
    each = salted_lookup(counted.select("row_id", "term", "tf", F.explode("sets").alias("set")), terms.select("set", "term", "term_id", "idf"), ["set", "term"], ["row_id"], large=True)
    cells = each.select("set", "row_id", "term_id", (F.col("tf") * F.col("idf")).alias("value"), F.lit(None).cast("double").alias("label"))
    cells = cells.unionByName(members.select("set", "row_id", F.lit(INTERCEPT).cast("long").alias("term_id"), F.lit(1.0).alias("value"), "label"))
    packed = cells.withColumn("block", block).groupBy("set", "block").applyInArrow(pack_cells(feature == "TFIDF"), BLOCK)
    blocks = stored(packed, "term-blocks")
    uses = None
    if any(k > 1 for _, k in sizes.values()):
        uses = stored(blocks.select("set", "block", "ids").mapInArrow(_ids, "set string, block int, term_id long"), "term-uses")
    return TermBlocks(terms, blocks, uses, sizes)


def pack_cells(normalise: bool):
    def pack(cells: pa.Table) -> pa.Table:
        row, term, value = (cells[c].to_numpy() for c in ("row_id", "term_id", "value"))
        order = np.lexsort((np.where(term == INTERCEPT, np.iinfo(np.int64).max, term), row))
        row, term, value = row[order], term[order], value[order]
        last = np.flatnonzero(term == INTERCEPT)  # one a row, behind its terms
        starts = np.concatenate([[0], last + 1])
        if normalise:
            squares = np.where(term == INTERCEPT, 0.0, value * value)
            norm = np.sqrt(np.add.reduceat(squares, starts[:-1]))
            value = np.where(term == INTERCEPT, value, value / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(starts)))
        labels = cells["label"].combine_chunks().take(pa.array(order[last])).to_numpy(zero_copy_only=False)
        ids, cols = np.unique(term, return_inverse=True)
        packed = [row[last].astype("<i8"), labels.astype("<f8"), starts.astype("<i8"), ids.astype("<i8"), cols.astype("<i4"), value.astype("<f8")]
        return pa.table([cells["set"].slice(0, 1), cells["block"].slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in packed)],
                        ["set", "block", "rows", "labels", "starts", "ids", "cols", "vals"])
    return pack


def _ids(batches):
    for batch in batches:
        for s, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ids = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(ids), pa.string()), pa.array([b] * len(ids), pa.int32()), pa.array(ids)], ["set", "block", "term_id"])


class Matrix:
    """A block as numpy arrays."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.rows, self.labels, self.starts = get("rows", "<i8"), get("labels", "<f8"), get("starts", "<i8")
        self.ids, self.cols, self.vals = get("ids", "<i8"), get("cols", "<i4"), get("vals", "<f8")
        self.of = np.repeat(np.arange(len(self.rows), dtype=np.int32), np.diff(self.starts))

    def distinct(self) -> tuple[Matrix, np.ndarray]:
        """The rows that differ in label or values, in their order, and how often each occurs."""
        first, at = self.same()
        return self.only(first), np.bincount(at, minlength=len(first)).astype(float)

    def same(self) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each kind, in their order, and the kind of every row; rows of a kind have the same label and values."""
        seen: dict[tuple, int] = {}
        first, at = [], np.empty(len(self.rows), np.int64)
        cuts = self.starts.tolist()
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            at[i] = seen.setdefault((self.labels[i], self.cols[a:z].tobytes(), self.vals[a:z].tobytes()), len(first))
            if at[i] == len(first):
                first.append(i)
        return np.array(first, np.int64), at

    def only(self, rows: np.ndarray) -> Matrix:
        """Some rows, by their places in ascending order."""
        if len(rows) == len(self.rows):
            return self
        held = np.zeros(len(self.rows), bool)
        held[rows] = True
        cells = held[self.of]
        return Matrix.of_arrays(self.rows[held], self.labels[held], np.concatenate([[0], np.cumsum(np.diff(self.starts)[held])]), self.ids, self.cols[cells], self.vals[cells])

    @staticmethod
    def of_arrays(rows: np.ndarray, labels: np.ndarray, starts: np.ndarray, ids: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> Matrix:
        out = object.__new__(Matrix)
        out.rows, out.labels, out.starts, out.ids, out.cols, out.vals = rows, labels, starts, ids, cols, vals
        out.of = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(starts))
        return out

    @staticmethod
    def joined(parts: list[Matrix]) -> Matrix:
        """The rows of several blocks of a set as one; ``parts`` is emptied, as each part is let go when it is read."""
        ids = parts[0].ids if len(parts) == 1 else np.unique(np.concatenate([m.ids for m in parts]))
        rows, labels, sizes = (np.concatenate(x) for x in ([m.rows for m in parts], [m.labels for m in parts], [np.diff(m.starts) for m in parts]))
        cols, vals, at = np.empty(sizes.sum(), "<i4"), np.empty(sizes.sum()), 0
        while parts:
            m = parts.pop(0)
            cols[at:at + len(m.cols)] = np.searchsorted(ids, m.ids).astype("<i4")[m.cols]
            vals[at:at + len(m.vals)] = m.vals
            at += len(m.vals)
        return Matrix.of_arrays(rows, labels, np.concatenate([[0], np.cumsum(sizes)]), ids, cols, vals)

    def times(self, w: np.ndarray) -> np.ndarray:
        """One number a row: its values times those of its terms."""
        return np.add.reduceat(self.vals * w[self.cols], self.starts[:-1])

    def back(self, a: np.ndarray) -> np.ndarray:
        """One number a term: its values times those of its rows."""
        return np.bincount(self.cols, self.vals * a[self.of], len(self.ids))


class Gram:
    """Some rows of a matrix, each times a number of its own, for products with the table of their inner products, which is not made.

    Columns that many rows have are kept dense, as far as ``cells`` of them go; a column of one row is a number of that row alone.
    """

    def __init__(self, m: Matrix, by: np.ndarray, rows: np.ndarray | None = None, cells: int = 12_000_000) -> None:
        if rows is not None:
            m, by = m.only(rows), by[rows]
        n = len(m.rows)
        vals, count = m.vals * by[m.of], np.bincount(m.cols, minlength=len(m.ids))
        order = np.argsort(-count, kind="stable")
        hot = min(int((count > 0.08 * n).sum()), cells // max(n, 1))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        cols = place[m.cols]
        dense = cols < hot
        self.dense = np.zeros((n, hot))
        self.dense[m.of[dense], cols[dense]] = vals[dense]
        alone = ~dense & (count[m.cols] == 1)
        self.single = np.bincount(m.of[alone], vals[alone] ** 2, n)
        rest = ~dense & ~alone
        self.cols, self.vals, self.of = cols[rest] - np.int32(hot), vals[rest], m.of[rest]
        self.width = max(0, int((count > 1).sum()) - hot)
        sizes = np.bincount(self.of, minlength=n)
        self.filled = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.filled]

    def times(self, a: np.ndarray) -> np.ndarray:
        out = self.dense @ (self.dense.T @ a) + self.single * a
        if len(self.vals):
            sums = np.bincount(self.cols, self.vals * a[self.of], self.width)
            out[self.filled] += np.add.reduceat(self.vals * sums[self.cols], self.starts)
        return out
