"""WARC archives: writing with revisit records, and reading that follows the chain of records from the file's start.

Writing. A record is one string: header, blank line, HTTP header and payload. Spark's text writer writes them with the
blank lines that end a record, so archives reach any store by Spark's commit protocol. Of rows with equal payloads
(SHA-1 and length) of at least ``least`` bytes, the one with the largest page_id is a response, the others revisit it;
they hold the HTTP header only.

Reading. Archives are read as text cut at the magic ``WARC/1.1`` line, so large files are split among tasks, and every
piece is a candidate record, also one whose magic stands inside a payload. A task gives each candidate the offset of its
successor (start + header + Content-Length + record end) relative to its split, and jumps pointers inside the split
until each candidate knows where its chain leaves it. Split sizes, summed per file, make offsets absolute. Pointer
doubling over the exits, from offset 0 of each file, finds where the true chain enters each split: log2(splits of a
file) rounds of joins over candidates. Marking each split's chain from its entry leaves exactly the reachable
records. Payloads that hold magic are put together from their pieces.

Defined cases: null html is an empty payload; a null url has no Target-URI header; a null page_id is written as
``null`` and read as null; equal rows (id and payload) are all written alike; white space and control characters of
URLs are escaped; an empty table gives empty archives and no rows; a chain that breaks off ends there, and what lies
behind it in that file is not read. Other columns are not read. Memory: offsets of one split, one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import few
from palimpsest.workspace import fresh_path, stored

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
SMALL = 200_000
DATE = "2000-01-01T00:00:00Z"
_PAGE = "urn:page:"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight times five hexadecimal digits become four characters."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    first = (rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
             .agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("d", "b", "first"))
    first = few(stored(first, "warc-copies"), SMALL)  # the payloads themselves are not dealt anew then
    joined = rows.join(first, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Archives of (page_id, url, html) under ``path``."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    rows = records(pages, least)
    page = lambda c: F.concat(F.lit(f"<{_PAGE}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    text = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", page(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", page(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(F.col("block")).cast("string")), F.lit("\r\n"), F.col("block"))
    rows.withColumn("block", block).select(text.alias("value")).write.option("lineSep", END).text(path)


# --- reading --------------------------------------------------------------------------------------------------

_FIELD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)\r?$")
_CANDIDATE = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("rel", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()), ("split_bytes", pa.int64()),
    ("record_type", pa.string()), ("page", pa.string()), ("url", pa.string()), ("refers", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("digest_read", pa.string()), ("whole", pa.bool_())])
_SCHEMA = ("file string, split long, rel long, next long, leaves long, split_bytes long, record_type string, page string, url string, refers string, "
           "payload_digest string, payload_bytes long, digest_read string, whole boolean")


def _parse(piece: bytes) -> dict | None:
    """Header fields of what follows a magic line; None if no record can start there."""
    head = piece.find(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _FIELD.findall(piece[:head])} if head >= 0 else {}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    begin, size = head + 4, int(length)
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    out = {"record_type": text(b"warc-type"), "page": text(b"warc-record-id"), "url": text(b"warc-target-uri"), "refers": text(b"warc-refers-to"),
           "payload_digest": (text(b"warc-payload-digest") or "").removeprefix("sha1:"), "size": begin + size + 4,
           "whole": len(piece) == begin + size + 4, "payload_bytes": None, "digest_read": None}
    http = piece.find(b"\r\n\r\n", begin)
    if http >= 0:
        inner = {k.lower(): v for k, v in _FIELD.findall(piece[begin:http])}
        out["payload_bytes"] = int(inner[b"content-length"]) if inner.get(b"content-length", b"").isdigit() else begin + size - http - 4
        if out["whole"] and out["record_type"] == "response":
            payload = piece[http + 4:begin + size]
            out |= {"payload_bytes": len(payload), "digest_read": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    return out


def _leaves(rel: np.ndarray, following: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate leaves the split (its successor at or behind ``total``); -1 if it breaks."""
    n = len(rel)
    at = np.searchsorted(rel, following)
    inside = (at < n) & (following >= 0)
    inside[inside] = rel[at[inside]] == following[inside]
    jump = np.where(inside, at, np.arange(n))
    for _ in range(max(n, 1).bit_length()):
        jump = jump[jump]
    last = following[jump]
    return np.where(last >= total, last, -1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, offset in the split, piece) of every piece behind a magic line. What stands before the first magic of
    a file has no magic of its own."""
    now, rel = None, 0
    for batch in batches:
        for file, split, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            piece = piece.as_py()
            if now != (file, split):
                now, rel = (file, split), 0
                if split == 0:
                    rel = len(piece)
                    yield file, split, -1, piece
                    continue
            yield file, split, rel, piece
            rel += len(MAGIC) + len(piece)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def flush() -> pa.RecordBatch:
        total = held[-1]["end"]
        rel, following = np.array([h["rel"] for h in held]), np.array([h["next"] for h in held])
        for h, x in zip(held, _leaves(rel, following, total)):
            h |= {"leaves": int(x), "split_bytes": total}
        out = pa.RecordBatch.from_pylist(held, _CANDIDATE)
        held.clear()
        return out

    blank = {k: None for k in ("record_type", "page", "url", "refers", "payload_digest", "payload_bytes", "digest_read")} | {"whole": False}
    for file, split, rel, piece in _walk(batches):
        if held and (held[0]["file"], held[0]["split"]) != (file, split):
            yield flush()
        if rel < 0:
            if piece:  # no record at the file's start: a piece that leads nowhere
                held.append({"file": file, "split": split, "rel": 0, "next": -1, "end": len(piece)} | blank)
            continue
        got = _parse(piece)
        size = got.pop("size") if got else None
        held.append({"file": file, "split": split, "rel": rel, "next": rel + len(MAGIC) + size if got else -1, "end": rel + len(MAGIC) + len(piece)} | (got or blank))
    if held:
        yield flush()


def _mark(key: tuple, table: pa.Table) -> pa.Table:
    """Rows on the chain from the entry of their split."""
    table = table.sort_by("rel")
    rel, following = table["rel"].to_numpy(), table["next"].to_numpy()
    at, on = {int(r): i for i, r in enumerate(rel)}, np.zeros(len(rel), bool)
    here = at.get(int(table["entry"][0].as_py()))
    while here is not None and not on[here]:
        on[here] = True
        here = at.get(int(following[here]))
    return table.filter(pa.array(on))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, record_type, page, url, refers, payload_digest, payload_bytes, digest_read of every reachable record."""
    found = stored(_pieces(spark, path).mapInArrow(_candidates, _SCHEMA), "warc-candidates")
    splits = found.groupBy("file", "split").agg(F.max("split_bytes").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stored(found.join(bases, ["file", "split"]).withColumn("offset", F.col("base") + F.col("rel")), "warc-placed")

    jumps = placed.filter("leaves >= 0").select("file", "offset", (F.col("base") + F.col("leaves")).alias("to"))
    reach = placed.filter("offset = 0").select("file", "offset")
    most = splits.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for k in range(int(most - 1).bit_length()):
        step = reach.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reach = stored(reach.unionByName(step).distinct(), "warc-reach")
        beyond = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        jumps = stored(jumps.join(beyond, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), "warc-jumps")

    entries = placed.join(reach, ["file", "offset"]).groupBy("file", "split").agg(F.min("rel").alias("entry"))
    columns = ["file", "offset", "split", "rel", "next", "entry", "record_type", "page", "url", "refers", "payload_digest", "payload_bytes", "digest_read", "whole"]
    chained = placed.join(entries, ["file", "split"]).select(*columns)
    kept = stored(chained.groupBy("file", "split").applyInArrow(_mark, chained.schema), "warc-records")
    return _complete(spark, path, placed, kept).select("file", "offset", "record_type", "page", "url", "refers", "payload_digest", "payload_bytes", "digest_read")


def _complete(spark: SparkSession, path: str, placed: DataFrame, kept: DataFrame) -> DataFrame:
    """Put payloads with magic inside together from their pieces and take their digest."""
    torn = kept.filter("not whole and record_type = 'response'")
    if torn.isEmpty():
        return kept
    starts = kept.select("file", "offset", F.col("offset").alias("record"), (~F.col("whole")).alias("torn"))
    until = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = (placed.select("file", "split", "rel", "offset").join(starts, ["file", "offset"], "left")
             .withColumns({"record": F.last("record", True).over(until), "torn": F.last("torn", True).over(until)}).filter("torn")
             .select("file", "split", "rel", "offset", "record"))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, rel, piece in _walk(batches):
            if rel >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), pa.array([rel], pa.int64()), pa.array([piece], pa.binary())], ["file", "split", "rel", "piece"])

    pieces = _pieces(spark, path).mapInArrow(located, "file string, split long, rel long, piece binary").join(owned, ["file", "split", "rel"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x.piece)  # pieces of one record
    whole = pieces.groupBy("file", "record").agg(parts.alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = MAGIC.encode().join(row["parts"])
                begin = content.find(b"\r\n\r\n") + 4
                fields = {k.lower(): v for k, v in _FIELD.findall(content[:begin])}
                payload = content[content.find(b"\r\n\r\n", begin) + 4:begin + int(fields[b"content-length"])]
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "offset": row["record"], "n": len(payload), "d": base64.b32encode(hashlib.sha1(payload).digest()).decode()}],
                                                 pa.schema([("file", pa.string()), ("offset", pa.int64()), ("n", pa.int64()), ("d", pa.string())]))
    mended = whole.mapInArrow(join, "file string, offset long, n long, d string")
    return kept.join(mended, ["file", "offset"], "left").withColumns({"payload_bytes": F.coalesce("n", "payload_bytes"), "digest_read": F.coalesce("d", "digest_read")})


def warc_report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives, read them back, and report each page from its record. A payload whose digest differs from its
    header has a null digest."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, least)
    id_of = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{_PAGE}([^>]*)', 1) AS BIGINT)")
    sound = F.col("digest_read").isNull() & (F.col("record_type") == "revisit") | (F.col("digest_read") == F.col("payload_digest"))
    return read_warc(spark, path).select(id_of("page").alias("page_id"), "payload_bytes", F.when(sound, F.col("payload_digest")).alias("payload_digest"),
                                         "record_type", id_of("refers").alias("refers_to"))
