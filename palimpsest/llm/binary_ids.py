"""Token ids in files: frequency ranks in byte-aligned variable-length code, control bytes apart from the data.

Documents are range-partitioned and sorted by id, encoded, and written in frames. A frame holds the ids of whole
documents, about ``frame_ids`` of them; its table lists its distinct ids, the most frequent first, and each id is
stored as its place in the table: one byte below 256, two below 65,536, and so on. Four lengths share a control
byte, and all control bytes stand before the data, so a reader finds every item's place with a table lookup and a
running sum, without a loop over ids. Each frame has its own table: no pass over the corpus comes first, a frame can be
read alone, and a lost task is simply run again.

Frame (little-endian): magic ``PIDS1\\0\\0\\0``; partition, frame number, documents, ids, table entries, data bytes
(u64 each); doc ids (i64), null flags of doc ids (u8), ids per document (u64), table (u32), control bytes, data.
Frames are values of one string column written by Spark's text writer, so they reach any store Spark can write, by
its commit protocol; a line end follows each frame. Readers go by lengths and never look for line ends.

Defined cases: null and empty texts give the end id only; a null doc_id comes first and stays null; rows with equal
ids are all kept, ordered by a hash of their text; an empty table gives no frames. Memory: one frame, or the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.encoding import Encoder
from palimpsest.llm.tokens import blocks, factorize
from palimpsest.workspace import fresh_path, stored

MAGIC = b"PIDS1\0\0\0"
FRAME_IDS = 1_000_000
FRAMES_A_FILE = 16

# of each control byte: the four lengths, and their sum
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes). Items that fill up the last control byte have length 1 and no data."""
    ranks = ranks.astype(np.uint32)
    length = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = length - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    start = np.cumsum(length) - length
    data = np.zeros(int(length.sum()), np.uint8)
    for k in range(4):
        has = length > k if k else slice(None)
        data[start[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    length = _LENGTHS[control].ravel()[:n]
    start = np.cumsum(length) - length
    out = data[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(length > k)
        if len(has):
            out[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def frame_bytes(part: int, number: int, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    codes, distinct = factorize(ids)
    order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    control, data = pack(rank[codes] if len(codes) else np.zeros(0, np.uint32))
    head = np.array([part, number, len(doc_ids), len(ids), len(distinct), len(data)], "<u8")
    missing = np.asarray(doc_ids.is_null())
    return b"".join([MAGIC, head.tobytes(), np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(),
                     counts.astype("<u8").tobytes(), distinct[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def frames(content: memoryview) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(partition, frame, doc ids, null flags, ids per document, all ids) of each frame of a file."""
    at = 0
    while at < len(content):
        if content[at:at + 1] == b"\n":
            at += 1
            continue
        if content[at:at + 8] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(content, kind, n, at)
            at += got.nbytes
            return got
        part, number, docs, n, entries, size = (int(x) for x in take("<u8", 6))
        doc_ids, missing, counts, table = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", entries)
        ranks = unpack(take("u1", -(-n // 4)), take("u1", size), n)
        yield part, number, doc_ids, missing.astype(bool), counts.astype(np.int64), table[ranks] if n else table


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, frame_ids: int = FRAME_IDS) -> None:
    """Encode every text of (doc_id, text) and write the files. ``tokenizer``: path of a tokenizers JSON file."""
    encoder = Encoder(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate([h[2] for h in held])
            out = frame_bytes(part, number, pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), ids)
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["frame"])

        for rows, _ in blocks(batches):
            ids, counts = encoder.encode(rows.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            held.append((rows.column(0).cast(pa.int64()), counts + 1, ids))
            if sum(len(h[2]) for h in held) >= frame_ids:
                yield flush()
        if held:
            yield flush()

    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
               .repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    (ordered.mapInArrow(write, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES_A_FILE).text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, frame, nth (document in its frame), doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, number, doc_ids, missing, counts, ids in frames(memoryview(content.as_buffer())):
                    cuts = np.concatenate([[0], np.cumsum(counts)])
                    for i in range(0, len(counts), 2000):
                        z = min(i + 2000, len(counts))
                        own = ids[cuts[i]:cuts[z]].astype("<u4")
                        offsets = ((cuts[i:z + 1] - cuts[i]) * 4).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(z - i, part), pa.int64()), pa.array(np.full(z - i, number), pa.int64()), pa.array(np.arange(i, z), pa.int64()),
                             pa.array(doc_ids[i:z], pa.int64(), mask=missing[i:z]), pa.array(counts[i:z], pa.int64()),
                             pa.BinaryArray.from_buffers(pa.binary(), z - i, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own.tobytes())])],
                            ["part", "frame", "nth", "doc_id", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(read, "part long, frame long, nth long, doc_id long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids in all documents before. ``rows`` must be stored: (part, frame, nth, n_tokens, ...)."""
    frames_of = rows.groupBy("part", "frame").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part", "frame").rowsBetween(Window.unboundedPreceding, -1)
    bases = frames_of.select(F.col("part").alias("p"), F.col("frame").alias("f"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "frame").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return (placed.join(bases, (F.col("part") == F.col("p")) & (F.col("frame") == F.col("f")))
            .withColumn("start", (F.col("start") + F.col("base")).cast("bigint")).drop("p", "f", "base"))


def ids_report(docs: DataFrame, tokenizer: str, end_id: int = 2, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write all ids, read the files back, and report doc_id, start, n_tokens, ids_crc32 of each document in them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id, frame_ids)
    rows = stored(read_ids(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
