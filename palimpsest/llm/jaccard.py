"""Near-duplicate documents: an exact Jaccard join on word shingles, by prefix filters under several token orders.

A document's set holds the distinct shingles of ``width`` lower-cased words (64-bit hashes). Two sets link when their
Jaccard similarity is at least ``percent`` / 100; the result is the connected component of each document.

Orders. One pass counts all shingles in a table of ``SKETCH`` counters of fixed size. Order A ranks a set's shingles by
counter, then by one hash; order B by the counter's magnitude, then by another. Similar sets share a shingle among the
first n - ceil(t n) + 1 of both, under either order (prefix filter). Rare shingles come first, so common passages seldom
reach a prefix. The counters only steer the work: any fixed order gives the same links.

Classes. Documents with equal sets are one class (hash of the sorted set); tasks send each class once, however many copies.

Candidates. Postings of the order-A prefixes are dealt by shingle and kept where two classes meet. Instead of all pairs of a
list, each class is paired with the first class of one of its lists, if sizes and places in the order allow it. A pair then must share an order-B prefix shingle
(``arrays_overlap``), and the rest is verified on whole sets. Verified links make components; a list inside one component
is finished, so a group of near copies costs pairs in proportion to its size. A second round pairs each class with ``CENTRES`` members, of
other components, of each of its open lists; what is left, pairs of different components in one list, is enumerated whole, by halves of
the components' ranks, so no pair inside a component is ever formed. Every linked pair is therefore verified or already connected.
Near copies share most of their prefixes, so many lists have the same members: of those, the first in the order stands for all.

Signatures. The first pass gives each document ``BITS`` bits: a shingle flips one, chosen by a hash. Two sets of n and m
shingles that differ in d have signatures that differ in d bits at most, and similar ones have (100 + percent) d <=
(100 - percent) (n + m). A pair whose signatures differ in more bits is not similar, so it is dropped before its sets are
fetched, in the last turn inside the join that makes the pairs. No similar pair is lost.

Hot lists. A shingle whose counter marks it as hot (``HOT``) is dealt with a salt of the class, in the first pass; lists are
reduced with map-side aggregation and joined by skew joins.

Sets travel only for classes in a candidate pair. Ids are broadcast only up to ``SMALL`` rows, beyond that they are joined.

Defined cases: null or empty text, or one without words: no shingles, linked with nothing, its own component; fewer words
than a shingle: the whole sequence is the one shingle; repeated rows and null ids are rows of their own (a component is
named by its smallest non-null id); texts are read whole; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.tables import few
from palimpsest.llm.tokens import Block, binary, blocks, factorize, mix, windows
from palimpsest.workspace import stored

WIDTH, PERCENT = 5, 75
SKETCH, SLICES = 1 << 20, 64
HOT, SALTS, SMALL = 20_000, 16, 300_000
CENTRES = 8
BITS = 1024
SIGNS = [f"s{k}" for k in range(BITS // 64)]


def shingles(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle of every text, grouped by text."""
    _, _, h, first = block.words()
    n = np.diff(first)
    w = windows(h, width)
    text = np.repeat(np.arange(block.rows), n)
    full = np.flatnonzero(text[:len(w)] == text[width - 1:]) if len(w) else np.zeros(0, np.int64)
    rows, values = [text[full]], [w[full]]
    for short in range(1, width):  # the whole sequence of a short text
        some = np.flatnonzero(n == short)
        if len(some):
            v = np.zeros(len(some), np.uint64)
            for k in range(short):
                v = mix(v * np.uint64(0x9FB21C651E98DF25) + h[first[some] + k])
            rows.append(some)
            values.append(mix(v ^ np.uint64(0x5851F42D4C957F2D + short)))
    text, value = np.concatenate(rows), np.concatenate(values)
    codes, _ = factorize(mix(value + text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    once = np.zeros(len(codes), bool)
    if len(codes):
        seen = np.full(codes.max() + 1, -1)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]
        once[seen] = True
    text, value = text[once], value[once]
    order = np.argsort(text, kind="stable")
    return text[order], value[order]


def sets_of(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, shingles sorted inside each text, class of each text)."""
    text, value = shingles(block, width)
    order = np.lexsort((value, text))
    value = value[order]
    cuts = np.searchsorted(text, np.arange(block.rows + 1))
    # position-dependent sum of the sorted set
    place = (np.arange(len(value)) - cuts[:-1][text]).astype(np.uint64)
    mixed = mix(value ^ mix(place + np.uint64(0x632BE59BD9B4E019)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    n = np.diff(cuts).astype(np.uint64)
    return cuts, value, mix(sums[cuts[1:]] - sums[cuts[:-1]] + n * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _cell(value: np.ndarray) -> np.ndarray:
    return (mix(value ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def signatures(cuts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A line of 64-bit numbers for each text: bit b says whether the text has an odd number of shingles with hash b."""
    rows = len(cuts) - 1
    bit = (mix(value ^ np.uint64(0xD1342543DE82EF95)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(rows), np.diff(cuts)) * BITS + bit, minlength=rows * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, BITS), axis=1).view("<i8")


def survey(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of documents (doc_id, n, class, signature) and rows of counters (slice, counts), from one pass; to be stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "class", "slice", "counts", *SIGNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at = np.zeros(SKETCH, np.uint32), None
        for rows, block in blocks(batches):
            cuts, value, cls = sets_of(block, width)
            at = rows.column(0).type
            cells, n = np.unique(_cell(value), return_counts=True)
            counts[cells] += n.astype(np.uint32)
            none = pa.nulls(block.rows, pa.int32())
            signs = [pa.array(s) for s in np.ascontiguousarray(signatures(cuts, value).T)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(cuts), pa.int64()), pa.array(cls), none, pa.nulls(block.rows, pa.binary()), *signs], names)
        if at is not None:
            parts = counts.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, at), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(np.arange(SLICES), pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()),
                                              *(pa.nulls(SLICES, pa.int64()) for _ in SIGNS)], names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, class long, slice int, counts binary, " + ", ".join(f"{s} long" for s in SIGNS))


def counters(found: DataFrame) -> np.ndarray:
    """Sum of the tasks' counters: SKETCH numbers, whatever the corpus."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"])
    out = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for row in found.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row.slice] = np.frombuffer(row.counts, "<i8")
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def _ranked(text: np.ndarray, value: np.ndarray, rank: np.ndarray, seed: int, rows: int) -> np.ndarray:
    """Order of the shingles of each text by (rank, hash with the seed)."""
    h = mix(value ^ np.uint64(seed))
    bits = max(int(rows).bit_length(), 1)
    key = (text.astype(np.uint64) << np.uint64(64 - bits)) | (np.minimum(rank, (1 << 21) - 1).astype(np.uint64) << np.uint64(64 - bits - 21)) | (h >> np.uint64(bits + 21))
    order = np.argsort(key)
    sorted_key = key[order]
    if len(order) and (sorted_key[1:] == sorted_key[:-1]).any():  # shortened hashes tie: compare them whole
        return np.lexsort((h, np.minimum(rank, (1 << 21) - 1), text))
    return order


def _prefix(cuts: np.ndarray, percent: int) -> np.ndarray:
    """First items of each text that a similar set must meet: n - ceil(t n) + 1."""
    n = np.diff(cuts)
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _taken(cuts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(cuts[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def postings(docs: DataFrame, table, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(token, class, info) of the order-A prefixes; a task sends each class once. info: salt, place in the order and size of the
    set, in 7, 28 and 28 bits."""
    mean = max(float(table.value.mean()), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = table.value, set()
        for rows, block in blocks(batches):
            cuts, value, cls = sets_of(block, width)
            n = np.diff(cuts)
            new = np.zeros(block.rows, bool)
            for i, c in enumerate(cls.tolist()):
                if n[i] and c not in seen:
                    new[i] = True
                    seen.add(c)
            if len(seen) > 1_000_000:  # bounds memory; a class sent twice is merged later
                seen = set()
            text = np.repeat(np.arange(block.rows), n)
            rank = counts[_cell(value)]
            order = _ranked(text, value, rank, 0x1234567, block.rows)
            size = np.where(new, _prefix(cuts, percent), 0)
            pick = order[_taken(cuts, size)]
            at = np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
            c = cls[text[pick]]
            hot = rank[pick] > mean + HOT
            salt = np.where(hot, 1 + (c.view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0)
            info = salt << 56 | at << 28 | n[text[pick]]
            yield pa.RecordBatch.from_arrays([pa.array(value[pick].view(np.int64)), pa.array(c), pa.array(info)], ["token", "class", "info"])
    return docs.select("text").mapInArrow(run, "token long, class long, info long")


def meeting(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, class, n, at, centre, m, mat, size): each list's distinct classes, where there are two at least that may fit
    another, or the list is salted; the first class of the list (of its salt) with its size and place; the length of the list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(parts: list[np.ndarray], open_end: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
            a = np.concatenate(parts, axis=1)
            key = a[0].view(np.uint64) * np.uint64(31) + (a[2] >> 56).view(np.uint64)
            head = np.ones(a.shape[1], bool)
            head[1:] = key[1:] != key[:-1]
            last = int(np.flatnonzero(head)[-1]) if open_end else a.shape[1]
            rest, a, head = a[:, last:], a[:, :last], head[:last]
            if not a.shape[1]:
                return None, [rest]
            fresh = head.copy()
            fresh[1:] |= a[1, 1:] != a[1, :-1]
            a, head = a[:, fresh], head[fresh]
            n, at, salted = a[2] & ((1 << 28) - 1), a[2] >> 28 & ((1 << 28) - 1), a[2] >> 56 > 0
            # the largest set that fits if this is the first shared shingle; a list must hold one that small, and one that allows this size
            largest = (n - at) * (100 + percent) // percent - n
            heads = np.flatnonzero(head)
            run_of = np.cumsum(head) - 1
            hope = (largest >= np.minimum.reduceat(n, heads)[run_of]) & (n <= np.maximum.reduceat(largest, heads)[run_of])
            keep = hope | salted
            length = np.bincount(run_of, weights=keep).astype(np.int64)[run_of]
            keep &= (length > 1) | salted
            a, n, at, run_of, length = a[:, keep], n[keep], at[keep], run_of[keep], length[keep]
            if not len(n):
                return None, [rest]
            begin = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
            first = begin[np.searchsorted(begin, np.arange(len(n)), side="right") - 1]
            small = lambda x: pa.array(x.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), small(n), small(at), pa.array(a[1][first]), small(n[first]), small(at[first]), small(length)], _LIST), [rest]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)]))
            got, held = out(held, True)
            if got is not None and got.num_rows:
                yield got
        if held and held[0].shape[1]:
            got, _ = out(held, False)
            if got is not None:
                yield got
    salt = F.shiftright("info", 56)
    return (lists.repartition("token", salt).sortWithinPartitions("token", salt, "class")
            .mapInArrow(run, "token long, class long, n int, at int, centre long, m int, mat int, size int"))


_LIST = ["token", "class", "n", "at", "centre", "m", "mat", "size"]


def _fits(n: str, at: str, m: str, mat: str, percent: int):
    """Can sets of these sizes be similar if this is the first shingle they share under order A? All others that they share
    are behind it. Of similar sets, the first shared one always passes."""
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(mat)) * (100 + percent) >= (F.col(n) + F.col(m)) * percent


def _close(n: str, m: str, x: str, y: str, percent: int):
    """Do the signatures leave room for similarity? x and y: what goes before the names of the signature's columns."""
    differing = sum((F.bit_count(F.col(x + s).bitwiseXOR(F.col(y + s))) for s in SIGNS[1:]), F.bit_count(F.col(x + SIGNS[0]).bitwiseXOR(F.col(y + SIGNS[0]))))
    return differing * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)


def _signed(signs: DataFrame, key: str, before: str) -> DataFrame:
    return signs.select(F.col("class").alias(key), F.col("n").alias(before + "n"), *[F.col(s).alias(before + s) for s in SIGNS])


def close_pairs(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for similarity."""
    pairs = _small(stored(pairs, "pairs"))
    first = _signed(signs, "a", "x").join(pairs, "a")
    other = _signed(signs, "b", "y").join(_small(pairs.select("b").distinct()), "b", "left_semi")
    return first.join(other, "b").filter(_close("xn", "yn", "x", "y", percent)).select("a", "b")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("class", "other").alias("a"), F.least("class", "other").alias("b")).distinct()


def first_pairs(lists: DataFrame, signs: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each class with one of the first classes of its lists, the one with most weight. Short lists weigh more: what few share
    tells most."""
    met = lists.filter("class <> centre").filter(_fits("n", "at", "m", "mat", percent))
    summed = met.groupBy("class", F.col("centre").alias("other")).agg(F.sum(1.0 / F.col("size")).alias("weight"))
    return close_pairs(_named(summed.groupBy("class").agg(F.max(F.struct("weight", "other")).alias("x")).select("class", F.col("x.other").alias("other"))), signs, percent)


def star_pairs(lists: DataFrame, signs: DataFrame, percent: int, turn: int) -> DataFrame:
    """Lists (token, class, n, at, comp): each class with those of its lists' ``CENTRES`` chosen members that are of another
    component. Each turn chooses others."""
    chosen = F.array(*[F.min(F.struct(F.xxhash64("class", F.lit(turn * CENTRES + k)).alias("h"), "comp", F.col("class").alias("other"), F.col("n").alias("m"), F.col("at").alias("mat"))) for k in range(CENTRES)])
    centres = lists.groupBy(F.col("token").alias("t")).agg(chosen.alias("centres"))
    both = lists.join(centres, F.col("token") == F.col("t")).select("class", "n", "at", "comp", F.explode(F.array_distinct("centres")).alias("c"))
    met = both.filter(F.col("comp") != F.col("c.comp")).select("class", "n", "at", "c.other", "c.m", "c.mat")
    return close_pairs(_named(met.filter(_fits("n", "at", "m", "mat", percent))), signs, percent)


def open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(token, class, n, at, comp) of the lists that hold several components; of lists with the same members, the one whose
    shingle is first in the order, where the members' places are least: whom it does not let meet, the others don't."""
    comps = _small(stored(components(links), "components")).withColumnRenamed("node", "class")
    named = lists.select("token", "class", "n", "at").join(comps, "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
    members = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"members{k}") for k in range(2)]
    several = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), F.min("at").alias("first"), *members).filter("low <> high")
    told = several.groupBy("size", "members0", "members1").agg(F.min(F.struct("first", "token")).alias("x")).select(F.col("x.token").alias("t"))
    return stored(named.join(_small(stored(told, "open-tokens")), F.col("token") == F.col("t"), "left_semi"), "open-lists")


def crossing_pairs(lists: DataFrame, signs: DataFrame, percent: int, turn: int) -> DataFrame:
    """All pairs of a list's members that lie in different components and fit, by places and by signatures."""
    from pyspark.sql import Window

    ranks = lists.select("token", "comp").distinct().withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy("comp")) - 1)
    top = ranks.groupBy("token").agg(F.max("r").alias("top")).filter("top > 0")
    signs = signs.drop("n").join(_small(stored(lists.select("class").distinct(), "open-classes")), "class", "left_semi")
    ranked = lists.join(ranks.join(top, "token"), ["token", "comp"]).join(signs, "class")
    # different ranks differ first in one bit: there, halves of a run of ranks meet
    at = ranked.withColumn("bit", F.explode(F.expr("sequence(0, cast(floor(log2(top)) as int))")))
    side = at.select("token", "bit", F.expr("shiftright(r, bit + 1)").alias("run"), (F.expr("shiftright(r, bit)") % 2).alias("half"), "class", "n", "at", *SIGNS)
    half = lambda k, x: side.filter(f"half = {k}").select("token", "bit", "run", F.col("class").alias(x), *[F.col(c).alias(x + c) for c in ("n", "at", *SIGNS)])
    met = half(0, "x").join(half(1, "y"), ["token", "bit", "run"]).filter(_fits("xn", "xat", "yn", "yat", percent) & _close("xn", "yn", "x", "y", percent))
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return few(df, SMALL)


def class_sets(docs: DataFrame, wanted: DataFrame, table, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(class, set, second): sorted set (binary) and order-B prefix of the wanted classes. wanted: (doc_id, class) of one
    document a class; rows with that doc_id and another set are left out."""
    chosen = docs.select("doc_id", "text").join(_small(wanted.withColumnRenamed("doc_id", "of")), F.col("doc_id") == F.col("of")).select("text", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for rows, block in blocks(batches):
            cuts, value, cls = sets_of(block, width)
            right = cls == np.asarray(rows.column(1))
            text = np.repeat(np.arange(block.rows), np.diff(cuts))
            magnitude = np.log2(counts[_cell(value)] + 1.0).astype(np.int32)
            size = _prefix(cuts, percent)
            pick = _ranked(text, value, magnitude, 0x7654321, block.rows)[_taken(cuts, size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            second = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[pick].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cls), binary(value, cuts), second], ["class", "set", "second"]).filter(pa.array(right))
    return chosen.mapInArrow(run, "class long, set binary, second array<long>")  # repeated rows give a class twice: links may repeat


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share an order-B prefix shingle and are similar. Sets travel only for pairs that pass the filter."""
    pairs = _small(pairs)
    first = sets.select(F.col("class").alias("a"), F.col("second").alias("pa")).join(pairs, "a")
    other = sets.select(F.col("class").alias("b"), F.col("second").alias("pb")).join(_small(pairs.select("b").distinct()), "b", "left_semi")
    passed = _small(stored(first.join(other, "b").filter(F.arrays_overlap("pa", "pb")).select("a", "b"), "candidates"))
    first = sets.select(F.col("class").alias("a"), F.col("set").alias("sa")).join(passed, "a")
    other = sets.select(F.col("class").alias("b"), F.col("set").alias("sb")).join(_small(passed.select("b").distinct()), "b", "left_semi")
    both = first.join(other, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text).

    Sets are fetched by id; where ids are null, the rows are numbered and stored first, and sets are fetched by number. A
    component without any id has a null component_id."""
    if docs.filter("doc_id is null").isEmpty():
        return _grouped(docs, width, percent)
    rows = stored(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = stored(_grouped(rows.select(F.col("_row").alias("doc_id"), "text"), width, percent), "numbered-groups")
    named = rows.select("doc_id", F.col("_row").alias("of")).join(found.withColumnRenamed("doc_id", "_row"), F.col("_row") == F.col("of"))
    names = named.groupBy(F.col("component_id").alias("component")).agg(F.min("doc_id").alias("least"))
    return (named.join(_small(names), F.col("component_id") == F.col("component"))
            .select("doc_id", "n_shingles", F.col("least").alias("component_id")))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    found = stored(survey(docs, width), "shingle-survey")
    members = found.filter("slice is null").select("doc_id", "n", "class")
    table = spark.sparkContext.broadcast(counters(found))
    lists = stored(meeting(postings(docs, table, width, percent), percent), "shared-shingles")
    namesakes = members.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    # equal sets have equal signatures
    signs = stored(found.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"), *[F.max(s).alias(s) for s in SIGNS]), "signatures")

    links = sets = None
    for turn, make in enumerate((first_pairs, star_pairs, crossing_pairs)):
        lists = lists if links is None else open_lists(lists, links)
        pairs = stored(make(lists, signs, percent, turn), "pairs")
        ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        if sets is not None:
            ends = ends.join(_small(sets.select("class")), "class", "left_anti")
        wanted = ends.join(namesakes, "class").select(F.col("least").alias("doc_id"), "class")
        more = stored(class_sets(docs, stored(wanted, "wanted"), table, width, percent), "sets")
        sets = more if sets is None else sets.unionByName(more)
        new = stored(verified(pairs, sets, percent), "links")
        links = new if links is None else links.unionByName(new)

    comps = components(links).select(F.col("node").alias("class"), "component")
    grouped = namesakes.join(comps, "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select(F.col("class").alias("c"), "component_id")
    return (members.join(named, (F.col("class") == F.col("c")) & (F.col("n") > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
