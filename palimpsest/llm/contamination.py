"""Benchmark decontamination with a distributed positional inverted index.

Index. Documents are gathered in segments of about ``SEGMENT`` bytes of text. A segment holds, for each of its terms, the sorted
list of word positions, and for each document the position of its first word; all segments together hold the postings of
every word of every document. Segments are rows of one Parquet table, so tasks read and match them alone.

Search. Benchmark items become windows of ``width`` words (an item of fewer words is one window). A pass over the term
columns counts the test terms in all segments. A window is looked up from its rarest term on: that term's postings, less
the term's offset, are the possible starts; each further term, in order of rarity, keeps the starts whose offset-adjusted
position is in its list. All windows of a chunk are intersected at once: a segment's postings, as (term, position), are one
sorted array. With ``slop`` above 0, a term may stand that many words from its place beside the rarest one (proximity match).

Benchmarks of any size are read in blocks of at most ``QUERY_WORDS`` words; each block is a pass over the index, and
only blocks travel to tasks. Hits of several blocks are merged per document.

Defined cases: null and empty texts have no words and are not contaminated; items without words match nothing; equal
items all count; a null item_id is listed as an empty string; repeated documents are kept as rows; an empty benchmark
leaves everything clean; other columns are not read. Terms are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tables import wide_rows
from palimpsest.llm.tokens import ALNUM, Block, binary, blocks, factorize
from palimpsest.workspace import stored

WIDTH, QUERY_WORDS, CHUNK = 13, 250_000, 100_000  # a block of windows is about 16 MB in a task
SEGMENT = 1 << 18  # bytes of text; small rows keep buffers small on their way through the JVM


# --- index ----------------------------------------------------------------------------------------------------

def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment: segment, doc_ids, firsts, terms, offsets, positions (little-endian arrays)."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows, block in blocks(batches, most=SEGMENT):
            _, _, h, first = block.words(ALNUM)
            codes, terms = factorize(h)
            rank = np.argsort(terms)
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            of = place[codes] if len(codes) else np.zeros(0, np.int64)
            positions = np.argsort(of, kind="stable").astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(terms)))]).astype("<u4")
            one = lambda a: binary(a, np.array([0, len(a)]))
            ids = pa.ListArray.from_arrays(pa.array([0, block.rows], pa.int32()), rows.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, one(first.astype("<u4")), one(terms[rank].astype("<u8")), one(offsets), one(positions)],
                                             ["segment", "doc_ids", "firsts", "terms", "offsets", "positions"])
            number += 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(index, f"segment long, doc_ids array<{kind}>, firsts binary, terms binary, offsets binary, positions binary")


# --- queries --------------------------------------------------------------------------------------------------

@dataclass
class Windows:
    """Windows of one block of items. ``terms`` is sorted; ``term`` and ``offset`` are windows by terms, -1 behind a short one."""

    items: list[str]
    item: np.ndarray
    length: np.ndarray
    terms: np.ndarray
    term: np.ndarray
    offset: np.ndarray

    def by_rarity(self, counts: np.ndarray) -> Windows:
        weight = np.where(self.term < 0, np.iinfo(np.int64).max, counts[np.maximum(self.term, 0)])
        order = np.argsort(weight, axis=1, kind="stable")
        return Windows(self.items, self.item, self.length, self.terms, np.take_along_axis(self.term, order, 1), np.take_along_axis(self.offset, order, 1))


def item_windows(ids: list, texts: list, width: int = WIDTH) -> Windows:
    block = Block(pa.array(texts, pa.string()))
    _, _, h, first = block.words(ALNUM)
    terms, code = np.unique(h, return_inverse=True)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - width, 0) + 1)
    item = np.repeat(np.arange(len(ids)), count)
    start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][item]
    length = np.minimum(n[item], width)
    offset = np.tile(np.arange(width), (len(item), 1))
    at = np.minimum(start[:, None] + offset, max(len(code) - 1, 0))
    term = np.where(offset < length[:, None], code[at] if len(code) else 0, -1)
    return Windows(["" if i is None else str(i) for i in ids], item, length, terms, term.astype(np.int32), offset.astype(np.min_scalar_type(width)))


def query_blocks(benchmark: DataFrame, width: int, most: int) -> Iterator[Windows]:
    """Blocks of whole items; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text or "") // 2
        if size >= most:
            yield item_windows(ids, texts, width)
            ids, texts, size = [], [], 0
    if ids:
        yield item_windows(ids, texts, width)


# --- matching -------------------------------------------------------------------------------------------------

def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value, or -1."""
    i = np.minimum(np.searchsorted(sorted_values, wanted), max(len(sorted_values) - 1, 0))
    return np.where(sorted_values[i] == wanted, i, -1) if len(sorted_values) else np.full(len(wanted), -1)


def match(windows: Windows, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray, first: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, document, start, end) of every match in one segment: the window's place around its rarest term, within the
    document. ``first``: first position of each document, and the end."""
    here = _find(terms, windows.terms)
    term = np.where(windows.term >= 0, here[np.maximum(windows.term, 0)] if len(here) else -1, -1)
    live = np.flatnonzero(((term >= 0) | (windows.term < 0)).all(axis=1))  # every term is in the segment
    keys = (np.repeat(np.arange(len(terms)), np.diff(offsets.astype(np.int64))) << 32) + positions.astype(np.int64)
    sizes = (offsets[1:].astype(np.int64) - offsets[:-1])[term[live, 0]] if len(live) else np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK, sizes.sum() + CHUNK, CHUNK)) + 1 if len(live) else []
    at = 0
    for end in cuts:
        some, n = live[at:end], sizes[at:end]
        at = int(end)
        if not len(some):
            continue
        w = np.repeat(some, n)
        begin = offsets[:-1].astype(np.int64)[term[some, 0]]
        p = positions[np.arange(len(w)) + np.repeat(begin - (np.cumsum(n) - n), n)].astype(np.int64)
        doc = np.searchsorted(first[1:], p, side="right")
        start = p - windows.offset[w, 0]
        for k in range(1, term.shape[1]):
            if not len(w):
                break
            t, place = term[w, k], start + windows.offset[w, k]
            low, high = np.maximum(place - slop, first[doc]), np.minimum(place + slop, first[doc + 1] - 1)
            i = np.searchsorted(keys, (t << 32) + low)
            there = (low <= high) & (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= (t << 32) + high)
            keep = there | (windows.term[w, k] < 0)
            w, start, doc = w[keep], start[keep], doc[keep]
        found.append((w, doc, np.maximum(start, first[doc]), np.minimum(start + windows.length[w], first[doc + 1])))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(f) for f in zip(*found))


def _array(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each test term occurs in the corpus; reads the term columns only."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                there, offsets = _array(batch, "terms", row, "<u8"), _array(batch, "offsets", row, "<u4").astype(np.int64)
                at = _find(there, terms)
                total += np.where(at >= 0, np.diff(offsets)[at] if len(there) else 0, 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])
    out = np.zeros(len(terms), np.int64)
    # at most one row a term of the block
    with wide_rows(index.sparkSession):
        for row in index.select("terms", "offsets").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[row.term] = row.n
    return out


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """segment, nth (document), starts, ends (merged spans of hit words, in the document), items (with a match)."""
    ordered = windows.by_rarity(term_counts(index, windows.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = batch.column(batch.schema.get_field_index("segment"))[row].as_py()
                first = _array(batch, "firsts", row, "<u4").astype(np.int64)
                w, doc, start, end = match(ordered, *(_array(batch, n, row, k) for n, k in (("terms", "<u8"), ("offsets", "<u4"), ("positions", "<u4"))), first, slop)
                out = []
                order = np.lexsort((start, doc))
                cuts = np.flatnonzero(np.diff(doc[order], prepend=-1))
                for a, z in zip(cuts, np.append(cuts[1:], len(order))):
                    mine = order[a:z]
                    d = int(doc[mine[0]])
                    s, e = merged(start[mine] - first[d], end[mine] - first[d])
                    out.append({"segment": segment, "nth": d, "starts": s.tolist(), "ends": e.tolist(), "items": sorted({ordered.items[i] for i in ordered.item[w[mine]]})})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("segment", pa.int64()), ("nth", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))
    return (index.select("segment", "firsts", "terms", "offsets", "positions")
            .mapInArrow(run, "segment long, nth long, starts array<long>, ends array<long>, items array<string>"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as sorted disjoint intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] if len(starts) else reach


def documents_hit(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 0, query_words: int = QUERY_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends, items for every row of (doc_id, text); empty lists where nothing matches."""
    with wide_rows(docs.sparkSession, 50):
        index = stored(build_index(docs), "postings")
    found = None
    for windows in query_blocks(benchmark, width, query_words):
        with wide_rows(docs.sparkSession):
            hits = stored(search(index, windows, slop), "hits")
        found = hits if found is None else found.unionByName(hits)
    sizes = index.select("segment", "doc_ids", "firsts").mapInArrow(_sizes, f"segment long, nth long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long")
    none = F.array().cast("array<bigint>")
    if found is None:
        return sizes.select("doc_id", "n_words", none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    # a document has at most one row for each block of the benchmark
    per = found.groupBy(F.col("segment").alias("s"), F.col("nth").alias("d")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])
    both = sizes.join(per, (F.col("segment") == F.col("s")) & (F.col("nth") == F.col("d")), "left")
    return both.select("doc_id", "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce(F.array_distinct("items"), F.array().cast("array<string>")).alias("items"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            first = _array(batch, "firsts", row, "<u4").astype(np.int64)
            n = len(first) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[row].as_py()), pa.int64()), pa.array(np.arange(n), pa.int64()), batch.column(1)[row].values, pa.array(np.diff(first), pa.int64())],
                                             ["segment", "nth", "doc_id", "n_words"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words, at least one)."""
    found = documents_hit(docs, benchmark, **options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, digest = [], []
            for starts, ends, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                s, e = merged(np.array(starts, np.int64), np.array(ends, np.int64))
                hit.append(int((e - s).sum()))
                digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(i) for i in batch.column(4).to_pylist()], pa.int64()), pa.array(digest, pa.string())],
                                             ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (found.mapInArrow(count, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
