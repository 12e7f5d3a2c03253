"""Vector compression by product codes, with nearest entries found by an integer Walsh-Hadamard transform.

Vectors become integers floor(1024 x) and are cut into equal consecutive parts; every part position has a codebook of integer
entries, improved by rounds of assigning and averaging. Parts and entries are padded with zeros to a power of two and transformed once: the
unnormalised transform keeps squared distances, times the padded length, and sorted by sequency its first coefficients
hold the slow changes. ``nearest`` adds scaled squared differences in that order. The full distance of the entry that
leads after the first coefficients is a bound; entries whose running sum passes it can't win any more and are left out of the
later coefficients, again after each doubling. All numbers are integers, so ties are true ties and go to the lower index.

Rounds are aggregations: tasks hold the codebooks (entries x length numbers), return sums and counts of their rows by entry and
position, and Spark adds these up; only such sums reach the driver. A lost executor costs the tasks it ran. The width
of the integers follows the largest component of the table: 32 or 64 bits, or Python's integers where 64 could overflow.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors (empty
ones too) and lengths that don't divide end in zeros; fewer rows than entries make smaller codebooks; equal ids and null ids are rows of
their own, null ids last in the choice of first entries, equal ids by their vectors; an error of 2^63 or more is null; an empty table, or
one without a kept row, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tables import few
from palimpsest.workspace import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
FIRST, CHUNK = 4, 512  # coefficients before the first bound; vectors worked on at once
LABELS = 100_000
LIMB = 40  # bits of the pieces in which sums travel


# --- transform and search ---------------------------------------------------------------------------------

def sequency(size: int) -> np.ndarray:
    """The places of the natural transform's coefficients by their number of sign changes; ``size`` is a power of two."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, unnormalised, padded with zeros to a power of two, in sequency order."""
    n, width = rows.shape
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((n, size), rows.dtype)
    out[:, :width] = rows
    half = 1
    while half < size:
        pairs = out.reshape(n, -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return out[:, sequency(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed rows and entries: the index of the nearest entry (the lowest among equals), and the padded length times its squared distance."""
    n, size = rows.shape
    head = min(FIRST, size)
    running = np.zeros((n, len(entries)), rows.dtype)
    for k in range(head):
        step = rows[:, k, None] - entries[None, :, k]
        running += step * step
    leader = running.argmin(1) if rows.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in running], np.int64)
    rest = rows[:, head:] - entries[leader, head:]
    bound = running[np.arange(n), leader] + (rest * rest).sum(1)
    row, entry = np.nonzero((running <= bound[:, None]).astype(bool))
    sums, done = running[row, entry], head
    while done < size:
        until = min(size, 2 * done)
        step = rows[row, done:until] - entries[entry, done:until]
        sums = sums + (step * step).sum(1)
        open_ = (sums <= bound[row]).astype(bool)
        row, entry, sums, done = row[open_], entry[open_], sums[open_], until
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(sums, first)
    best = np.flatnonzero((sums == least[row]).astype(bool))
    winner = best[np.searchsorted(row[best], np.arange(n))]
    return entry[winner], sums[winner]


# --- integers ---------------------------------------------------------------------------------------------

@dataclass
class Layout:
    """What all tasks need: the length of a part, and the width of the integers."""

    parts: int
    part: int
    kind: str

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.kind)


def _layout(length: int, largest: float, parts: int, scale: int) -> Layout:
    part = max(1, -(-length // parts))
    padded = 1 << max(part - 1, 0).bit_length()
    most = int(math.ceil(largest)) * scale + 1
    bits = (4 * padded * padded * most * most).bit_length()  # no running sum of squares is larger
    return Layout(parts, part, "int32" if bits < 32 else "int64" if bits + parts.bit_length() < 64 else "object")


def integers(vectors: pa.Array, layout: Layout, scale: int) -> np.ndarray:
    """floor(scale x) of a list column, one row per vector, zeros behind short ones."""
    width = layout.parts * layout.part
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    if layout.kind == "object":
        # components from 2^53 on are whole numbers
        values = np.array([int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in flat.astype(float).tolist()], object)
    else:
        values = np.floor(flat.astype(np.float64) * scale).astype(layout.dtype)
    out = np.zeros((len(lengths), width), layout.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    out[row, np.arange(len(values)) - first[row]] = values
    return out


def _assigned(rows: np.ndarray, layout: Layout, coded: list[np.ndarray]) -> tuple[np.ndarray, list]:
    """Codes, and squared distances over all parts, of integer vectors."""
    codes, total = np.zeros((len(rows), layout.parts), np.int64), np.zeros(len(rows), object if layout.kind == "object" else np.int64)
    for p in range(layout.parts):
        mine = transform(rows[:, p * layout.part:(p + 1) * layout.part])
        for a in range(0, len(rows), CHUNK):
            code, sums = nearest(mine[a:a + CHUNK], coded[p])
            codes[a:a + CHUNK, p] = code
            total[a:a + CHUNK] += sums.astype(total.dtype) // mine.shape[1]
    return codes, total


# --- rounds -----------------------------------------------------------------------------------------------

def _entry_sums(layout: Layout, books: np.ndarray, scale: int):
    """Sums and counts of a task's vectors: (cell, limb, amount), cells numbered over part, entry and position, counts behind."""
    parts, entries, part = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [transform(b) for b in books.astype(layout.dtype)]
        sums = np.zeros((parts, entries, part + 1), object if layout.kind == "object" else np.int64)
        for batch in batches:
            rows = integers(batch.column(0), layout, scale)
            codes, _ = _assigned(rows, layout, coded)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first, count = np.unique(codes[order, p], return_index=True, return_counts=True)
                if len(used):
                    sums[p, used, :part] += np.add.reduceat(rows[order, p * part:(p + 1) * part].astype(sums.dtype), first, axis=0)
                    sums[p, used, part] += count
        flat = sums.reshape(-1)
        cells = np.flatnonzero((flat != 0).astype(bool))
        amounts, limb = flat[cells].astype(object), 0
        while len(cells):
            low = np.array([x & ((1 << LIMB) - 1) for x in amounts], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), limb)), pa.array(low)], ["cell", "limb", "amount"])
            amounts = np.array([x >> LIMB for x in amounts], object)
            if all(-1 <= x <= 0 for x in amounts):  # only signs are left
                below = cells[np.array(amounts, np.int64) < 0]
                yield pa.RecordBatch.from_arrays([pa.array(below), pa.array(np.full(len(below), limb + 1)), pa.array(np.full(len(below), -1))], ["cell", "limb", "amount"])
                break
            limb += 1
    return work


def _kept(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    bad: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes and codebooks: a stored table (vec_id, label, code array<int>, error) and integers by (part, entry, position)."""
    rows = _kept(vectors.select("vec_id", "embedding", "label")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    seen = rows.agg(F.max(F.size("embedding")).alias("length"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("largest")).first()
    layout = _layout(seen.length or 0, seen.largest or 0.0, parts, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # ``entries`` vectors
    start = integers(pa.array([r.embedding for r in first], pa.list_(pa.float64())), layout, scale)
    books = np.stack([start[:, p * layout.part:(p + 1) * layout.part] for p in range(parts)])
    values = rows.select("embedding")
    for _ in range(rounds if len(first) else 0):
        found = values.mapInArrow(_entry_sums(layout, books, scale), "cell long, limb long, amount long")
        sums = np.zeros(parts * len(first) * (layout.part + 1), object)
        for r in found.groupBy("cell", "limb").agg(F.sum("amount").alias("amount")).collect():  # sums of the codebooks
            sums[r.cell] += int(r.amount) << (LIMB * r.limb)
        sums = sums.reshape(parts, len(first), layout.part + 1)
        books = books.copy()
        for p, e in zip(*np.nonzero((sums[:, :, -1] > 0).astype(bool))):
            books[p, e] = [x // sums[p, e, -1] for x in sums[p, e, :-1]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [transform(b) for b in books.astype(layout.dtype)]
        for batch in batches:
            codes, error = _assigned(integers(batch.column(1), layout, scale), layout, coded)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * parts, pa.int32()), pa.array(codes.reshape(-1), pa.int32()))
            fits = [int(x) if x < 1 << 63 else None for x in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), code, pa.array(fits, pa.int64())], ["vec_id", "label", "code", "error"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long")
    return stored(coded, "vector-codes"), books


def codebook_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def compression_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    coded, books = compress(vectors, **options)
    totals = few(stored(coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error")), "label-errors"), LABELS)
    rows = coded.alias("r").join(totals.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")), "left")
    code = F.array_join(F.transform("r.code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("r.vec_id", code.alias("code"), "r.error", "l.label_error", F.lit(codebook_hash(books)).alias("codebooks_sha256"))
