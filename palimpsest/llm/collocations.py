"""Phrase collocations from sorted count streams.

Counting. Every word of a piece opens a window of up to ``longest`` words; how often a phrase occurs is how many windows begin with it, so
one table of windows counts phrases of all lengths. Tasks sort the windows of a block of text, count equal ones and cut the sorted
stream at boundaries that are the same for all blocks (quantiles of a sample; they only balance). A cut-off run travels as one row, each window without the words
that it shares with the one before. Where the runs of a bucket meet they are sorted again, in prefix order, and the counts of all
phrases are lengths of runs of equal prefixes. A phrase counts as it stands unless a boundary begins with it: such parts are added up over buckets.

Streams. The frequent phrases are kept in two orders: by their words (prefix order) and by their words from the last to the first (suffix order). A scan in
prefix order meets a phrase after all its beginnings and before all its extensions to the right; the open ones form a stack. So one pass gives the counts
of all beginnings (left counts) and tells whether an extension is as frequent; suffix order gives ends (right counts) and extensions to the left. No
table of counts is looked up by hash: both streams are sorted by phrase once more and meet in a merge join. A phrase inside a longer one of its count is also inside
one that is one word longer and as frequent, so these two extensions decide.

Scale. Buckets hold about ``bucket`` bytes of text, whatever word or pair is hot, since boundaries are whole windows; equal windows of a block are one entry. More than
``bounds`` buckets are dealt by a hash of their first two words. Streams are cut by phrases in the same way; a phrase that begins
(ends) a boundary is copied to the tasks behind it. Only boundaries reach the driver. The last step takes each language's best in two rounds.

Defined cases: null and empty texts have no words; a null lang is ``und``; rows with one id, and repeated rows, all count; ties in score go to the larger count,
then to the phrase of lower bytes; a language without candidates gives no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import few
from palimpsest.llm.tokens import BYTES, LOWER, Block, blocks
from palimpsest.workspace import stored

LONGEST, LEAST, TOP, UNKNOWN = 5, 100, 2000, "und"
BUCKET, BOUNDS, SAMPLES, STREAM = 2_500_000, 65_536, 50, 200_000
BLOCK_BYTES, SALTS = 1 << 21, 64
_BREAKS = np.isin(BYTES, [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_INSIDE = ~(_BREAKS | (BYTES == 32) | (BYTES == 9))

Phrase = tuple[bytes, ...]  # the language, then words


# --- windows of a block -----------------------------------------------------------------------------------

def _windows(block: Block, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words end to end, their lengths, the row of each, and how many words the window at each has."""
    starts, ends = block.spans(_INSIDE)
    row = block.owner(starts)
    piece = np.cumsum(_BREAKS[block.data])[starts] if len(starts) else starts
    n = len(starts)
    last = np.append(np.flatnonzero((row[1:] != row[:-1]) | (piece[1:] != piece[:-1])), n - 1) if n else starts
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1 if n else starts
    return LOWER[block.data][_INSIDE[block.data]], ends - starts, row, np.minimum(left, longest)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of rows by columns of numbers from 0 on, and which rows of that order differ from the one before."""
    keys, room = [], 0
    for c in columns:
        bits = int(c.max()).bit_length() if len(c) else 0
        if not keys or bits > room:
            keys.append(c.astype(np.uint64))
            room = 64 - bits
        else:
            keys[-1] = (keys[-1] << np.uint64(bits)) | c.astype(np.uint64)
            room -= bits
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _languages(batch: pa.RecordBatch) -> list[bytes]:
    return [UNKNOWN.encode() if x is None else str(x).encode() for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]


def sample(docs: DataFrame, step: int, longest: int = LONGEST) -> DataFrame:
    """One window in ``step`` of every block: (lang, phrase)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, most=BLOCK_BYTES):
            data, lengths, row, size = _windows(block, longest)
            first, langs = np.concatenate([[0], np.cumsum(lengths)]), _languages(rows)
            raw, found = data.tobytes(), []
            for i in range(zlib.crc32(raw[:1000]) % step, len(lengths), step):
                found.append((langs[row[i]].decode(), b" ".join(raw[first[j]:first[j + 1]] for j in range(i, i + size[i])).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["lang", "phrase"])
    return docs.mapInArrow(work, "lang string, phrase string")


def _phrase(lang: str, words: str) -> Phrase:
    return (lang.encode(), *words.encode().split(b" "))


def _quantiles(phrases: list[Phrase], parts: int) -> list[Phrase]:
    phrases = sorted(phrases)
    return sorted({phrases[i * len(phrases) // parts] for i in range(1, parts)}) if phrases else []


def _runs(bounds: list[Phrase], deals: int, longest: int):
    """Sorted windows with counts, cut at the boundaries: a row for each bucket and language of a block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = [w for b in bounds for w in b[1:]]
        fixed = np.frombuffer(b"".join(flat), np.uint8), np.array([len(w) for w in flat], np.int64), np.array([len(b) - 1 for b in bounds], np.int64)
        for rows, block in blocks(batches, most=BLOCK_BYTES):
            data, lengths, row, size = _windows(block, longest)
            if not len(lengths):
                continue
            # boundaries are windows of count 0 before all others, so sorting finds their places
            words = _binary(np.concatenate([fixed[0], data]), np.concatenate([fixed[1], lengths])).dictionary_encode()
            known = words.dictionary.to_pylist()
            rank = np.empty(len(known), np.int64)
            ordered = sorted(range(len(known)), key=known.__getitem__)
            rank[ordered] = np.arange(1, len(known) + 1)
            code = rank[words.indices.to_numpy()]
            size = np.concatenate([fixed[2], size])
            at = np.concatenate([np.cumsum(fixed[2]) - fixed[2], np.arange(len(flat), len(code))])
            langs = _languages(rows)
            names = sorted({*langs, *(b[0] for b in bounds)})
            number = {x: k for k, x in enumerate(names)}
            lang = np.concatenate([np.array([number[b[0]] for b in bounds], np.int64), np.array([number[x] for x in langs], np.int64)[row]])
            columns = [lang] + [np.where(j < size, code[np.minimum(at + j, len(code) - 1)], 0) for j in range(longest)]
            order, new = _order(columns)
            first = np.flatnonzero(new)
            count = np.add.reduceat((order >= len(bounds)).astype(np.int64), first)
            bucket = np.cumsum(order < len(bounds))[np.append(first[1:], len(order)) - 1]
            held = count > 0
            count, bucket, one = count[held], bucket[held], order[first[held]]
            columns, size = np.stack([c[one] for c in columns]), size[one]
            deal = np.zeros(len(one), np.int64)
            if deals > 1:
                mark = np.array([0] + [zlib.crc32(known[k]) for k in ordered])
                deal = (mark[columns[1]] * 31 + mark[columns[2]]) % deals
                again = np.lexsort((np.arange(len(one)), deal, bucket))
                count, bucket, deal, columns, size = count[again], bucket[again], deal[again], columns[:, again], size[again]
            cut = np.ones(len(one), bool)
            cut[1:] = (bucket[1:] != bucket[:-1]) | (deal[1:] != deal[:-1]) | (columns[0, 1:] != columns[0, :-1])
            shared = np.zeros(len(one), np.int64)
            shared[1:] = np.logical_and.accumulate(columns[1:, 1:] == columns[1:, :-1], axis=0).sum(0)
            shared[cut] = 0
            own = size - shared
            begin = np.cumsum(own) - own
            which = np.repeat(np.arange(len(one)), own)
            codes = columns[1 + shared[which] + np.arange(len(which)) - begin[which], which]
            text = pa.array([known[k] + b" " for k in ordered], pa.large_binary()).take(pa.array(codes - 1))
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            raw = text.buffers()[2].to_pybytes()
            starts = np.flatnonzero(cut)
            stops = np.append(starts[1:], len(one))
            spans = list(zip(starts.tolist(), stops.tolist()))
            begin = np.append(begin, len(which))
            head, tally = (shared * 8 + size).astype(np.uint8), count.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[starts].astype(np.int32)), pa.array(deal[starts].astype(np.int32)), pa.array([names[k].decode() for k in columns[0, starts]], pa.string()),
                pa.array([head[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([tally[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([raw[ends[begin[a]]:ends[begin[b]]] for a, b in spans], pa.binary())], ["bucket", "deal", "lang", "heads", "counts", "words"])
    return work


def _counted(bounds: list[Phrase], deals: int, longest: int, least: int):
    """Counts of the phrases of a bucket: all of at least ``least``, and those that go on beyond the bucket."""
    def work(runs: pa.Table) -> pa.Table:
        bucket = runs["bucket"][0].as_py()
        heads = [np.frombuffer(x, np.uint8).astype(np.int64) for x in runs["heads"].to_pylist()]
        langs = runs["lang"].to_pylist()
        names = sorted(set(langs))
        lang = np.repeat([names.index(x) for x in langs], [len(h) for h in heads])
        head = np.concatenate(heads)
        count = np.frombuffer(b"".join(runs["counts"].to_pylist()), "<u4").astype(np.int64)
        shared, size = head >> 3, head & 7
        data = np.frombuffer(b"".join(runs["words"].to_pylist()), np.uint8)
        ends = np.flatnonzero(data == 32) + 1
        words = _binary(data, np.diff(ends, prepend=0)).dictionary_encode()
        known, code = [w[:-1] for w in words.dictionary.to_pylist()], words.indices.to_numpy().astype(np.int64) + 1
        begin = np.cumsum(size - shared) - (size - shared)
        columns, at = [lang], np.arange(len(head))
        for j in range(longest):
            says = (shared <= j) & (j < size)
            source = np.maximum.accumulate(np.where(says, at, 0))
            columns.append(np.where(j < size, code[np.minimum(begin[source] + j - shared[source], len(code) - 1)], 0))
        order, _ = _order(columns)
        columns, count = [c[order] for c in columns], count[order]
        out: list[tuple[str, str, int]] = []
        numbers = {w: k + 1 for k, w in enumerate(known)}
        edges = [bounds[k] for k in (bucket - 1, bucket) if 0 <= k < len(bounds)]
        new = np.zeros(len(order), bool)
        new[0] = True
        for m in range(longest + 1):
            new[1:] |= columns[m][1:] != columns[m][:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(count, first)
            wanted = (total >= least) | (m == 0) | ((m == 1) & (deals > 1))
            for edge in edges:
                if m < len(edge) and edge[0].decode() in names:
                    of = [names.index(edge[0].decode()), *(numbers.get(w, -1) for w in edge[1:m + 1])]
                    wanted |= np.all([columns[k][first] == v for k, v in enumerate(of)], axis=0)
            wanted &= (m == 0) | (columns[m][first] > 0)
            for i, n in zip(first[wanted], total[wanted].tolist()):
                out.append((names[columns[0][i]], b" ".join(known[columns[k][i] - 1] for k in range(1, m + 1)).decode("utf-8", "replace"), n))
        return pa.table({"lang": pa.array([x[0] for x in out], pa.string()), "phrase": pa.array([x[1] for x in out], pa.string()), "f": pa.array([x[2] for x in out], pa.int64())})
    return work


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bucket: int = BUCKET, bounds: int = BOUNDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``longest`` words found ``least`` times, and (lang, n) words; both stored."""
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // bucket)
    deals, parts = max(1, -(-parts // bounds)), min(parts, bounds)
    cuts: list[Phrase] = []
    if parts > 1:
        step = max(1, size // (6 * SAMPLES * parts))
        cuts = _quantiles([_phrase(r.lang, r.phrase) for r in sample(docs, step, longest).collect()], parts)  # about SAMPLES windows a bucket
    runs = docs.mapInArrow(_runs(cuts, deals, longest), "bucket int, deal int, lang string, heads binary, counts binary, words binary")
    found = runs.groupBy("bucket", "deal").applyInArrow(_counted(cuts, deals, longest, least), "lang string, phrase string, f long")
    counts = stored(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == "")), "phrase-counts")
    return counts.filter("phrase <> ''"), counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))


# --- streams ----------------------------------------------------------------------------------------------

def stream(phrases: DataFrame, backwards: bool, rows: int = STREAM) -> DataFrame:
    """One scan of the phrases in prefix order, or in suffix order: (lang, phrase, f, counts of its shorter beginnings or ends, covered, own).

    ``covered``: it has an extension of one word that is as frequent. Rows that aren't ``own`` are copies in later tasks.
    """
    def ordered(lang: str, words: str) -> Phrase:
        phrase = _phrase(lang, words)
        return (phrase[0], *phrase[:0:-1]) if backwards else phrase

    n = phrases.count()
    parts = min(-(-n // rows), BOUNDS)
    cuts: list[Phrase] = []
    if parts > 1:
        chosen = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(max(1, n // (SAMPLES * parts)))) == 0)
        cuts = _quantiles([ordered(r.lang, r.phrase) for r in chosen.select("lang", "phrase").collect()], parts)  # about SAMPLES phrases a part

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row, own = [], [], []
            for i, (lang, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                phrase = ordered(lang, words)
                p = bisect_right(cuts, phrase)
                part.append(p), row.append(i), own.append(True)
                while p < len(cuts) and cuts[p][:len(phrase)] == phrase:
                    p += 1
                    part.append(p), row.append(i), own.append(False)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *taken.columns, pa.array(own, pa.bool_())], ["part", "lang", "phrase", "f", "own"])

    def scan(table: pa.Table) -> pa.Table:
        lines = sorted((ordered(r["lang"], r["phrase"]), r["f"], k) for k, r in enumerate(table.select(["lang", "phrase", "f"]).to_pylist()))
        counts, covered = [None] * len(lines), [False] * len(lines)
        open_: list[tuple[Phrase, int, int]] = []
        for phrase, f, k in lines:
            while open_ and phrase[:len(open_[-1][0])] != open_[-1][0]:
                open_.pop()
            counts[k] = [x[1] for x in open_]
            if open_ and f >= open_[-1][1]:
                covered[open_[-1][2]] = True
            open_.append((phrase, f, k))
        return table.select(["lang", "phrase", "f"]).append_column("counts", pa.array(counts, pa.list_(pa.int64()))).append_column("covered", pa.array(covered)).append_column("own", table["own"])
    dealt = phrases.mapInArrow(deal, "part int, lang string, phrase string, f long, own boolean")
    return dealt.groupBy("part").applyInArrow(scan, "lang string, phrase string, f long, counts array<long>, covered boolean, own boolean")


def lowest_cut(a: int, n: int, before: list[int], after: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, the first of equal ones; exact integers of any size."""
    cuts = [(1000 * a * n // (l * r), l, r) for l, r in zip(before, reversed(after))]
    return min(cuts, key=lambda c: c[0])


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    phrases, totals = frequent_phrases(docs, **options)
    left, right = (stored(stream(phrases, backwards), "phrase-stream") for backwards in (False, True))
    copies = left.unionByName(right).filter("covered AND NOT own").select("lang", "phrase").distinct()
    whole = "own AND NOT covered AND size(counts) > 0"
    met = (left.filter(whole).select("lang", "phrase", F.col("f").alias("a"), F.col("counts").alias("before")).hint("merge")
           .join(right.filter(whole).select("lang", "phrase", F.col("counts").alias("after")), ["lang", "phrase"])
           .join(few(copies, 100_000), ["lang", "phrase"], "left_anti").join(few(totals, 100_000), "lang"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [lowest_cut(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), *(pa.array([b[k] for b in best], pa.int64()) for k in range(3))], ["lang", "phrase", "a", "n", "score", "l", "r"])
    scored = met.select("lang", "phrase", "a", "n", "before", "after").mapInArrow(score, "lang string, phrase string, a long, n long, score long, l long, r long")
    by = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*by)
    best = scored.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
