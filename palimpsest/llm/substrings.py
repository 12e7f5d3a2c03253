"""Removing repeated substrings: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

Anchors. Each of a text's windows of LENGTH bytes is assigned to an anchor, the k-gram with the smallest hash among the
first ``SPREAD`` of the window (the last one on ties). Equal windows have equal anchors at equal distances, so an anchor with
its windows can only repeat where the ``CORE`` bytes behind it, which all its windows hold, occur again. About two
anchors in ``SPREAD`` bytes travel, dealt by a hash of their core; anchors alone with their core are done.

Anchors with equal bytes over all their windows repeat as a whole. Where one core has several contexts, windows must be
compared: each differs from others by the bytes left of the anchor and right of the core only. Contexts (one of each kind) are
fetched from the texts and meet by core. There, two symbol strings a context, its right side and its reversed left
side, behind a symbol for the core, are sorted by one suffix array (``suffixes``, linear grouping over Lyndon prefixes).
Longest common prefixes of neighbours then give, for every distance d of anchor and window start, classes of contexts with
equal d bytes on the left and LENGTH - CORE - d on the right; a window repeats where a class pair holds two.

Hot spots. Texts that are exact copies are counted first and only one of them is searched (a copy of at least LENGTH bytes is
removed whole). Runs of equal cores are read as a stream, a row at a time in memory. Cores with more than ``HOT``
contexts are not brought together: their windows are counted by hash, with map-side aggregation.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH keep everything; overlapping repeats (also of a
text with itself) count; rows with equal id and text are treated alike; the input is judged as it is, not what is left
of it; other columns are not read. Bytes are compared by 64-bit hashes while searching for candidates and whole windows of
exact copies, and byte by byte where contexts meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.suffixes import suffix_array
from palimpsest.llm.tables import few
from palimpsest.llm.tokens import Block, binary, blocks, mix
from palimpsest.workspace import stored

LENGTH, GRAM, SPREAD = 200, 16, 145
SYMBOL = 24
HOT, SMALL, GROUPED = 50_000, 1_000_000, 12_000


# --- anchors --------------------------------------------------------------------------------------------------

def _least(values: np.ndarray, spread: int) -> np.ndarray:
    """Minimum of every run of ``spread`` values: prefixes and suffixes of aligned pieces."""
    n = len(values)
    padded = np.full(-(-n // spread) * spread, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    pieces = padded.reshape(-1, spread)
    ahead = np.minimum.accumulate(pieces, axis=1).ravel()
    back = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - spread + 1], ahead[spread - 1:n])


def anchors(block: Block, length: int = LENGTH, spread: int = SPREAD) -> dict[str, np.ndarray]:
    """Anchors with windows: text, at (position in the block), first and last window start, core and whole hashes."""
    core = length - spread + 1
    n = len(block.data)
    names = ("text", "at", "first", "last", "core", "whole")
    starts = np.zeros(n, bool)  # windows that lie in one text
    sizes = np.diff(block.bounds)
    count = np.maximum(sizes - length + 1, 0)
    long = np.flatnonzero(count)
    if not len(long):
        return {k: np.zeros(0, np.int64) for k in names}
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, block.bounds[:-1][long], 1)
    np.add.at(mark, block.bounds[:-1][long] + count[long], -1)
    starts = np.flatnonzero(np.cumsum(mark[:-1]))
    prefix = block.prefix_hash()
    place = np.arange(n - GRAM + 1)
    h = block.hashes(place, place + GRAM, prefix)
    low = _least((h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place.astype(np.uint64)), spread)
    at = (np.uint64(0xFFFFFFFF) - (low[starts] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    text = np.repeat(long, count[long])
    head = np.ones(len(starts), bool)
    head[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(starts)) - 1
    at, first, last = at[heads], starts[heads], starts[tails]
    whole = block.hashes(first, last + length, prefix)
    return {"text": text[heads], "at": at, "first": first, "last": last, "core": block.hashes(at, at + core, prefix),
            "whole": mix(whole + (at - first).astype(np.uint64))}


def _anchor_rows(length: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches):
            a = anchors(block, length, spread)
            base = block.bounds[a["text"]]
            twin = np.asarray(rows.column(1), bool)[a["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["core"].view(np.int64)), pa.array(a["whole"].view(np.int64)), pa.array(np.asarray(rows.column(0))[a["text"]]), pa.array((a["at"] - base).astype(np.int32)),
                 pa.array((a["at"] - a["first"]).astype(np.int16)), pa.array((a["at"] - a["last"]).astype(np.int16)), pa.array(twin)],
                ["core", "whole", "key", "at", "most", "least", "twin"])
    return run


_ANCHOR = "core long, whole long, key long, at int, most short, least short, twin boolean"


# --- verdicts by core -----------------------------------------------------------------------------------------

_VERDICT = "key long, at int, most short, least short, core long, ask boolean, repeated boolean"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by (core, whole). ``repeated``: all windows occur twice. ``ask``: the first of each whole where its core has
    several, whose contexts must be compared. A stream: the last row waits for the next, the first of a core for a second whole."""
    columns = ("core", "whole", "key", "at", "most", "least", "twin")
    before: tuple | None = None  # (core, whole) in front of the waiting row
    waiting: list[np.ndarray] | None = None
    first_of_core: list | None = None

    def told(row: list[np.ndarray], ask: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
        keep = ask | repeated
        take = [row[columns.index(c)][keep] for c in ("key", "at", "most", "least", "core")] + [ask[keep], repeated[keep]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in take], [x.split()[0] for x in _VERDICT.split(", ")])

    def decide(a: list[np.ndarray], ended: bool) -> Iterator[pa.RecordBatch]:
        nonlocal before, first_of_core
        core, whole, twin = a[0], a[1], a[6]
        n = len(core) if ended else len(core) - 1
        if not n:
            return
        new_core, new_whole = np.ones(len(core), bool), np.ones(len(core), bool)
        new_core[1:] = core[1:] != core[:-1]
        new_whole[1:] = new_core[1:] | (whole[1:] != whole[:-1])
        if before is not None:
            new_core[0] = core[0] != before[0]
            new_whole[0] = new_core[0] or whole[0] != before[1]
        again = ~np.append(new_whole[1:], True)  # the next row has the same whole
        run = np.cumsum(new_core[:n])
        second = new_whole[:n] & ~new_core[:n]
        several = np.bincount(run, weights=second, minlength=run[-1] + 1) > 0
        if first_of_core is not None and several[0]:
            yield told(first_of_core, np.array([True]), np.array([False]))
            first_of_core = None
        ask = new_whole[:n] & (~new_core[:n] | several[run])
        yield told([x[:n] for x in a], ask, ~new_whole[:n] | again[:n] | twin[:n].astype(bool))
        heads = np.flatnonzero(new_core[:n])
        if len(heads):
            first_of_core = None if several[run[-1]] else [x[heads[-1]:heads[-1] + 1] for x in a]
        before = (core[n - 1], whole[n - 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        now = now if waiting is None else [np.concatenate(x) for x in zip(waiting, now)]
        yield from decide(now, False)
        waiting = [x[-1:] for x in now]
    if waiting is not None:
        yield from decide(waiting, True)


# --- contexts -------------------------------------------------------------------------------------------------

_CONTEXT = "core long, key long, at int, most short, least short, repeated boolean, left binary, right binary"


def _contexts(length: int, spread: int):
    """Bytes left of the anchor (reversed) and right of the core, as far as windows reach, for the positions asked."""
    core = length - spread + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches):
            asked = rows.column(2)
            n = np.asarray(pa.compute.list_value_length(asked)).astype(np.int64)
            item = asked.flatten()
            get = lambda k: item.field(k).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            base = np.repeat(block.bounds[:-1], n)
            at = base + get("at")
            left, right = get("most").astype(np.int64), spread - 1 - get("least").astype(np.int64)

            def cut(first: np.ndarray, step: int, size: np.ndarray) -> pa.Array:
                ends = np.cumsum(size)
                inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
                return binary(block.data[np.repeat(first, size) + step * inside], np.concatenate([[0], ends]))  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(get("core")), pa.array(np.repeat(np.asarray(rows.column(1)), n)), pa.array(get("at")), pa.array(get("most")), pa.array(get("least")), pa.array(get("repeated")),
                 cut(at - 1, -1, left), cut(at + core, 1, right)], [x.split()[0] for x in _CONTEXT.split(", ")])
    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values as rows of bytes, filled up with zeros."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    size = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = data[offsets[0]:offsets[-1]]
    return out


def _symbols(sides: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of ranks of SYMBOL bytes each."""
    words = np.ascontiguousarray(sides).view(">u8").reshape(-1, SYMBOL // 8).astype(np.uint64)
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[:, k])
    codes, _ = pd.factorize(h)
    some = np.zeros(codes.max() + 1, np.int64)
    some[codes] = np.arange(len(codes))
    order = np.lexsort(words[some].T[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes].reshape(len(sides), -1)


def _sorted_sides(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in order of (group, left) and of (group, right), by one suffix array over both strings of all contexts."""
    n = len(group)
    ranks = _symbols(np.concatenate([left, right]))
    width = ranks.shape[1]
    groups = int(group.max()) + 1
    text = np.empty((n, 2, width + 1), np.int64)
    text[:, 0, 0], text[:, 1, 0] = group, groups + group
    text[:, 0, 1:], text[:, 1, 1:] = ranks[:n] + 2 * groups, ranks[n:] + 2 * groups
    order = suffix_array(text.ravel())
    heads = order[order % (width + 1) == 0] // (width + 1)
    return heads[heads % 2 == 0] // 2, heads[heads % 2 == 1] // 2


def _common(order: np.ndarray, group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Bytes that each context in order has in common with the one before it; -1 at a group's first."""
    out = np.full(len(order), -1)
    if len(order) > 1:
        same = side[order[1:]] == side[order[:-1]]
        out[1:] = np.where(same.all(axis=1), side.shape[1], same.argmin(axis=1))
        out[1:][group[order[1:]] != group[order[:-1]]] = -1
    return out


def repeated_windows(core: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, least: np.ndarray, repeated: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, distance) of every window that another context of its core has, or a repeated one."""
    group, _ = pd.factorize(core)
    by_left, by_right = _sorted_sides(group, left, right)
    common_left, common_right = _common(by_left, group, left), _common(by_right, group, right)
    found = []
    for d in range(int(least.min()), int(most.max()) + 1):
        there = (least <= d) & (d <= most)
        classes = np.empty((2, len(group)), np.int64)
        classes[0, by_left] = np.cumsum(common_left < d)
        classes[1, by_right] = np.cumsum(common_right < spread - 1 - d)
        some = np.flatnonzero(there)
        codes, _ = pd.factorize(classes[0, some] * (len(group) + 1) + classes[1, some])
        several = np.bincount(codes, weights=1 + repeated[some]) > 1
        hit = some[several[codes] & ~repeated[some]] if len(some) else some
        found.append(np.stack([hit, np.full(len(hit), d)]))
    both = np.concatenate(found, axis=1)
    order = np.lexsort((both[1], both[0]))
    return both[0][order], both[1][order]


_SPAN = "key long, start int, end int"


def _spans_of(key: np.ndarray, at: np.ndarray, context: np.ndarray, distance: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of neighbouring windows as spans of the text."""
    new = np.ones(len(context) + 1, bool)
    new[1:-1] = (context[1:] != context[:-1]) | (distance[1:] != distance[:-1] + 1)
    cuts = np.flatnonzero(new)
    heads, tails = cuts[:-1], cuts[1:] - 1
    c = context[heads]
    return pa.RecordBatch.from_arrays([pa.array(key[c].astype(np.int64)), pa.array((at[c] - distance[tails]).astype(np.int32)), pa.array((at[c] - distance[heads] + length).astype(np.int32))], ["key", "start", "end"])


def _compared(length: int, spread: int, grouped: int):
    """Contexts sorted by core, whole cores at a time, about ``grouped`` contexts in one suffix array."""
    width = -(-(spread - 1) // SYMBOL) * SYMBOL

    def solve(table: pa.Table) -> pa.RecordBatch:
        get = lambda k: table[k].combine_chunks().to_numpy(zero_copy_only=False)
        left, right = _matrix(table["left"].combine_chunks(), width), _matrix(table["right"].combine_chunks(), width)
        context, distance = repeated_windows(get("core"), left, right, get("most").astype(np.int64), get("least").astype(np.int64), get("repeated").astype(bool), spread)
        return _spans_of(get("key"), get("at").astype(np.int64), context, distance, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for first in range(0, batch.num_rows, grouped):
                held.append(batch.slice(first, grouped))
                if sum(b.num_rows for b in held) < grouped:
                    continue
                table = pa.Table.from_batches(held)
                core = table["core"].combine_chunks().to_numpy()
                cut = int(np.flatnonzero(np.append(True, core[1:] != core[:-1]))[-1])
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))
    return run


def _counted(contexts: DataFrame, length: int, spread: int) -> DataFrame:
    """The same for cores with very many contexts: windows counted by hash, no context meets another."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                around = Block(pa.array([row["left"][::-1] + row["right"]], pa.binary()))
                prefix = around.prefix_hash()
                d = np.arange(row["least"], row["most"] + 1)
                first = len(row["left"]) - d
                h = mix(around.hashes(first, first + spread - 1, prefix) + d.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(row["core"] & (2**64 - 1)))
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, 2 if row["repeated"] else 1), pa.int32()), pa.array(np.full(n, row["key"]), pa.int64()),
                                                  pa.array((row["at"] - d).astype(np.int32)), pa.array(np.full(n, row["repeated"]), pa.bool_())], ["window", "weight", "key", "start", "repeated"])
    found = stored(contexts.mapInArrow(windows, "window long, weight int, key long, start int, repeated boolean"), "hot-windows")
    twice = found.groupBy(F.col("window").alias("w")).agg(F.sum("weight").alias("n")).filter("n > 1").select("w")
    return found.filter("not repeated").join(twice, F.col("window") == F.col("w"), "left_semi").select("key", "start", (F.col("start") + length).cast("int").alias("end"))


# --- tables ---------------------------------------------------------------------------------------------------

def _few(df: DataFrame) -> DataFrame:
    return few(df, SMALL)


def repeated_spans(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, hot: int = HOT, grouped: int = GROUPED) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: key, digest, n_bytes, copies for every row, with doc_id. spans: key, start, end (bytes), not merged,
    of the texts that are searched (one of each set of exact copies)."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = stored(keyed.select("doc_id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")), "texts")
    copies = stored(texts.groupBy("key").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least")).filter("n > 1"), "copies")
    joined = keyed.filter(F.octet_length("text") >= length).join(_few(copies.withColumnRenamed("key", "of")), F.col("key") == F.col("of"), "left")
    searched = joined.filter(F.col("n").isNull() | (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("least")))
    sent = searched.select("key", F.col("n").isNotNull().alias("twin"), "text").mapInArrow(_anchor_rows(length, spread), _ANCHOR)
    verdicts = stored(sent.repartition("core").sortWithinPartitions("core", "whole").mapInArrow(_verdicts, _VERDICT), "verdicts")
    whole = verdicts.filter("repeated").select("key", (F.col("at") - F.col("most")).cast("int").alias("start"), (F.col("at") - F.col("least") + length).cast("int").alias("end"))

    asked = verdicts.filter("ask").groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("at", "most", "least", "core", "repeated")).alias("asked"))  # positions of one text
    wanted = _few(verdicts.filter("ask").select(F.col("key").alias("k")).distinct())
    sources = _one_of_each(keyed, copies).join(wanted, F.col("key") == F.col("k"), "left_semi")
    contexts = sources.join(asked, F.col("key") == F.col("of")).select("text", "key", "asked").mapInArrow(_contexts(length, spread), _CONTEXT)
    crowded = stored(verdicts.filter("ask").groupBy(F.col("core").alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("c"), "crowded")
    if crowded.isEmpty():
        meet, apart = contexts, None
    else:
        contexts = stored(contexts, "contexts")
        meet = contexts.join(_few(crowded), F.col("core") == F.col("c"), "left_anti")
        apart = _counted(contexts.join(_few(crowded), F.col("core") == F.col("c"), "left_semi"), length, spread)
    part = meet.repartition("core").sortWithinPartitions("core").mapInArrow(_compared(length, spread, grouped), _SPAN)
    spans = whole.unionByName(part) if apart is None else whole.unionByName(part).unionByName(apart)
    return texts.join(_few(copies.select(F.col("key").alias("of"), "n")), F.col("key") == F.col("of"), "left").select("doc_id", "key", "digest", "n_bytes", F.coalesce("n", F.lit(1)).alias("copies")), spans


def _one_of_each(keyed: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, key) but for exact copies beside the one with the smallest id."""
    joined = keyed.join(_few(copies.select(F.col("key").alias("of"), "least")), F.col("key") == F.col("of"), "left")
    return joined.filter(F.col("least").isNull() | (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("least"))).select("doc_id", "text", "key")


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def substring_report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of (doc_id, text)."""
    texts, spans = repeated_spans(docs, length, **options)
    # spans of one text, as one row
    lists = stored(spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    single = texts.filter("copies = 1")
    cut = lists.join(single.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi")
    touched = keyed.join(_few(cut.select(F.col("key").alias("k"))), F.col("key") == F.col("k"), "left_semi")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches):
            removed, runs, digest = [], [], []
            for i, own in enumerate(rows.column(1)):
                item = own.values
                s, e = _merge(item.field("start").to_numpy(), item.field("end").to_numpy())
                keep = np.ones(block.bounds[i + 1] - block.bounds[i], bool)
                for a, z in zip(s.tolist(), e.tolist()):
                    keep[a:z] = False
                removed.append(int((~keep).sum()))
                runs.append(len(s))
                digest.append(hashlib.sha256(block.data[block.bounds[i]:block.bounds[i + 1]][keep].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["k", "n_removed", "n_spans", "kept"])
    shorter = (touched.join(cut.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("text", "spans", "key")
               .mapInArrow(remove, "k long, n_removed long, n_spans long, kept string"))
    both = single.join(shorter, F.col("key") == F.col("k"), "left")
    alone = both.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
                        F.coalesce("kept", "digest").alias("kept_sha256"))
    gone = F.col("n_bytes") >= length  # an exact copy repeats from its first byte to its last
    nothing = hashlib.sha256(b"").hexdigest()
    copied = texts.filter("copies > 1").select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"),
                                               F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n_spans"), F.when(gone, F.lit(nothing)).otherwise(F.col("digest")).alias("kept_sha256"))
    return alone.unionByName(copied)
