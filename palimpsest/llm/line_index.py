"""Line deduplication that can be extended and taken back: cuckoo filters by shard over exact reference tables.

A line's key is a 128-bit BLAKE2 digest of the line without white space at its ends and with A-Z lower-cased; lines of fewer than ``least`` code
points have none. ``LineIndex`` is a value: ``insert`` and ``delete`` return a new index and leave the old one as it was, so a
job that is run again starts from the same state.

References. An append-only table of (key, doc_id, version, present): which documents hold which keys. The latest version of a pair counts. The
reference count of a key is the number of its documents, its keeper the smallest doc_id.

Filters. Keys are dealt to shards by their first bits; a shard's cuckoo filter holds a key once if one document has it and twice if two or
more have it. Batches ask the filters first. ``insert`` reads old references only of keys that a filter may know: all others are new.
``delete`` takes copies out, so a filter stays as small as what it stands for. ``report`` looks up exact counts only of keys with two copies or
more; the filters never miss one, and the reference counts settle what they report too much. A filter that would run full is built anew from the
reference counts.

Scale. Lines travel as 16-byte keys. Keys are combined before they are dealt, so a line in a third of all documents is one row of a task
in its shard; its references are spread by document (salted joins). Shards hold about ``SHARD_KEYS`` keys; a document's dropped keys are gathered by
document. Texts move once, to meet the keys that they lose.

Defined cases: a null or empty text is one empty line; rows with one doc_id are one document, null ids too (after all others); repeated rows change
nothing; inserting a document again adds what its text has now; deleting unknown ids does nothing; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.cuckoo import Cuckoo
from palimpsest.operators.skew import salted_lookup
from palimpsest.workspace import fresh_path, stored

LEAST, SHARD_KEYS, ROWS = 10, 200_000, 50_000
_BLANKS = b" \t\n\x0b\x0c\r"
_FILTER = "shard long, buckets long, room long, items long, slots binary, stash binary"


# --- keys -------------------------------------------------------------------------------------------------

def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    line = line.strip(_BLANKS).lower()  # of bytes: A-Z only
    if len(line) < least or len(line) < 4 * least and len(line.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def keys_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, doc_id) of every document, each key once a row."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            keys, rows = [], []
            for row, text in enumerate(texts):
                found = {line_key(line, least) for line in text.as_py().split(b"\n")}
                found.discard(None)
                keys += found
                rows += [row] * len(found)
                if len(keys) >= ROWS or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], ["key", "doc_id"])
                    keys, rows = [], []
    return docs.select("doc_id", "text").mapInArrow(extract, f"key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def _shard(bits: int) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 32 - bits)


def _rows(keys: pa.ChunkedArray) -> np.ndarray:
    """Binary keys as rows of 16 bytes."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 16)


def _opened(table: pa.Table) -> Cuckoo | None:
    if not table.num_rows:
        return None
    row = table.to_pylist()[0]
    return Cuckoo(row["buckets"], row["slots"], row["stash"])


def _present(log: DataFrame) -> DataFrame:
    """The pairs whose latest version is present."""
    latest = log.groupBy("key", "doc_id").agg(F.max(F.col("version") * 2 + F.col("present").cast("int")).alias("last"))
    return latest.filter("last % 2 = 1").select("key", "doc_id")


# --- index ------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class LineIndex:
    spark: SparkSession
    ids: str  # type of doc_id
    references: tuple[str, ...] = ()
    filters: str | None = None
    bits: int = 0
    least: int = LEAST
    shard_keys: int = SHARD_KEYS

    # tables

    def _log(self) -> DataFrame:
        schema = f"key binary, doc_id {self.ids}, version int, present boolean"
        return self.spark.read.schema(schema).parquet(*self.references) if self.references else self.spark.createDataFrame([], schema)

    def holders(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, doc_id) of the documents in the index, each pair once; of the given distinct keys only."""
        log = self._log() if keys is None else salted_lookup(self._log(), keys.select("key"), ["key"], ["doc_id"])
        return _present(log)

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """Reference counts: (key, docs, keeper)."""
        return self.holders(keys).groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("keeper"))

    def _filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTER).parquet(self.filters) if self.filters else self.spark.createDataFrame([], _FILTER)

    def known(self, keys: DataFrame, copies: int = 1) -> DataFrame:
        """Those of the distinct keys of which their filter reports so many copies; no key that has them is missing."""
        def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
            cuckoo = _opened(held)
            found = np.zeros(asked.num_rows, bool) if cuckoo is None or not asked.num_rows else cuckoo.copies(_rows(asked["key"])) >= copies
            return asked.select(["key"]).filter(pa.array(found))
        dealt = keys.select(_shard(self.bits).alias("shard"), "key").groupBy("shard")
        return dealt.cogroup(self._filters().groupBy("shard")).applyInArrow(probe, "key binary")

    # changes

    def _appended(self, pairs: DataFrame, present: bool) -> tuple[str, ...]:
        path = fresh_path(self.spark, "line-references")
        pairs.select("key", "doc_id", F.lit(len(self.references)).alias("version"), F.lit(present).alias("present")).write.parquet(path)
        return (*self.references, path)

    def _built(self, references: tuple[str, ...], bits: int, copies: DataFrame) -> LineIndex:
        """The index with these references and new filters of (key, change), the copies of all keys."""
        bare = LineIndex(self.spark, self.ids, references, None, bits, self.least, self.shard_keys)
        return bare._updated(copies.withColumn("shard", _shard(bits)), bare._filters())

    def _changed(self, references: tuple[str, ...], steps: DataFrame) -> LineIndex:
        """The index with these references; ``steps`` has the copies by which its filters' keys change: (key, change)."""
        new = LineIndex(self.spark, self.ids, references, self.filters, self.bits, self.least, self.shard_keys)
        steps = stored(steps.filter("change <> 0").withColumn("shard", _shard(self.bits)), "line-steps")
        added = steps.groupBy("shard").agg(F.sum("change").alias("change"))
        full = stored(self._filters().join(added, "shard").filter("items + change > room").select("shard"), "line-full")
        if full.isEmpty():
            return new._updated(steps, self._filters())
        # a filter that would run full is built anew from the exact counts
        log = new._log().withColumn("shard", _shard(self.bits)).join(full, "shard", "left_semi")
        anew = _present(log).groupBy("key").agg(F.least(F.count("*"), F.lit(2)).alias("change")).withColumn("shard", _shard(self.bits))
        kept = steps.join(full, "shard", "left_anti").select("key", "change", "shard")
        return new._updated(kept.unionByName(anew), self._filters().join(full, "shard", "left_anti"))

    def _updated(self, steps: DataFrame, old: DataFrame) -> LineIndex:
        def update(changes: pa.Table, held: pa.Table) -> pa.Table:
            keys, change = _rows(changes["key"]), changes["change"].to_numpy()
            cuckoo = _opened(held) or Cuckoo.sized(int(change.sum()))
            for times in (1, 2):
                cuckoo.remove(keys[change <= -times])
                cuckoo.add(keys[change >= times])
            shard = (changes if changes.num_rows else held)["shard"][0].as_py()
            row = {"shard": shard, "buckets": cuckoo.buckets, "room": cuckoo.room, "items": cuckoo.items, "slots": cuckoo.slots.tobytes(), "stash": cuckoo.stash.tobytes()}
            return pa.Table.from_pylist([row], pa.schema([(n, pa.binary() if n in ("slots", "stash") else pa.int64()) for n in row]))
        path = fresh_path(self.spark, "line-filters")
        steps = steps.select("shard", "key", F.col("change").cast("int").alias("change"))
        steps.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(update, _FILTER).write.parquet(path)
        return LineIndex(self.spark, self.ids, self.references, path, self.bits, self.least, self.shard_keys)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents' lines."""
        pairs = stored(keys_of(docs, self.least), "line-pairs")
        references = self._appended(pairs, True)
        held = self._filters().agg(F.sum("items")).first()[0] or 0
        bits = max(0, math.ceil(math.log2(max(1, held + pairs.count()) / self.shard_keys)))
        if not held:
            two = F.min("doc_id").eqNullSafe(F.max("doc_id")) & ~(F.min("doc_id").isNotNull() & F.bool_or(F.col("doc_id").isNull()))
            return self._built(references, bits, pairs.groupBy("key").agg(F.when(two, 1).otherwise(2).alias("change")))
        if bits > self.bits + 1:  # the index has outgrown its shards
            new = LineIndex(self.spark, self.ids, references, None, bits, self.least, self.shard_keys)
            return self._built(references, bits, new.counts().select("key", F.least("docs", F.lit(2)).alias("change")))
        old = stored(self.known(pairs.select("key").distinct()), "line-known")
        before = self.holders(old).withColumn("was", F.lit(1))
        after = before.unionByName(pairs.withColumn("was", F.lit(0))).groupBy("key", "doc_id").agg(F.max("was").alias("was"))
        change = F.least(F.count("*"), F.lit(2)) - F.least(F.sum("was"), F.lit(2))
        return self._changed(references, after.groupBy("key").agg(change.alias("change")))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of these ids (column doc_id)."""
        if not self.filters:
            return self
        gone = ids.select(F.col("doc_id").alias("_id")).distinct()
        pairs = self.holders()
        pairs = stored(pairs.join(gone, pairs.doc_id.eqNullSafe(gone._id), "left_semi"), "line-pairs")
        after = self.holders(pairs.select("key").distinct()).withColumn("gone", F.lit(0)).unionByName(pairs.withColumn("gone", F.lit(1))).groupBy("key", "doc_id").agg(F.max("gone").alias("gone"))
        change = F.least(F.count("*") - F.sum("gone"), F.lit(2)) - F.least(F.count("*"), F.lit(2))
        steps = after.groupBy("key").agg(change.alias("change"))
        return self._changed(self._appended(pairs, False), steps)

    # result

    def report(self, docs: DataFrame) -> DataFrame:
        """doc_id, text without the lines that a smaller document of the index keeps, n_lines, n_dropped; for documents of the index."""
        docs = docs.select("doc_id", "text")
        pairs = stored(keys_of(docs, self.least), "line-pairs")
        asked = stored(self.known(pairs.select("key").distinct(), 2), "line-known")
        shared = stored(self.counts(asked).filter("docs > 1"), "line-shared")
        dropped = salted_lookup(pairs, shared, ["key"], ["doc_id"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        dropped = dropped.groupBy("doc_id").agg(F.collect_set("key").alias("dropped")).withColumnRenamed("doc_id", "_id")
        least = self.least

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, lines, gone = [], [], []
                for text, keys in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                    text, keys = text.as_py(), keys.as_py()
                    lines.append((text or b"").count(b"\n") + 1)
                    if keys and text:
                        keys = set(keys)
                        rest = [line for line in text.split(b"\n") if line_key(line, least) not in keys]
                        gone.append(lines[-1] - len(rest))
                        text = b"\n".join(rest)
                    else:
                        gone.append(0)
                    kept.append(text)
                text = pa.array(kept, pa.large_binary()).cast(pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])
        met = docs.join(dropped, docs.doc_id.eqNullSafe(dropped._id), "left").select("doc_id", "text", "dropped")
        return met.mapInArrow(drop, f"doc_id {self.ids}, text string, n_lines long, n_dropped long")


def empty_index(docs: DataFrame, **options) -> LineIndex:
    return LineIndex(docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), **options)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: all documents inserted into an empty index, then asked for."""
    kept = empty_index(docs, **options).insert(docs).report(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
