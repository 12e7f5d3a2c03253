import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import warc
from palimpsest.workspace import fresh_path

SCHEMA = "page_id long, url string, html string, source string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for page, _, html, _ in rows:
        html = html or ""
        size = len(html.encode())
        same = [r[0] for r in rows if (r[2] or "") == html and r[0] is not None]
        first = max(same) if same else None
        revisit = size >= least and first is not None and page != first
        out.append((page, size, digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/x", "<p>one</p>", "s"), (2, "http://a/y z\r\n", "<p>one</p>", None), (3, None, None, None), (4, "u", "", "s"),
    (5, "u", FAKE * 3, "s"), (6, "u", "x WARC/1.1\r\n y\r\n\r\n", "s"), (7, "u", "é中\r\n\r\n\r\n\r\nWARC/1.1\r\n", "s"),
    (8, "u", "WARC/1.1\r\n" * 40, "s"), (9, "u", "WARC/1.1\r\nContent-Length: 100000000\r\n\r\n", "s"), (10, "u", "<p>one</p>", "s"),
    (11, "u", FAKE + "tail", "s"), (None, "u", "no id", "s"), (12, "u", "long " * 40000, "s"), (12, "u", "long " * 40000, "s"),
]


@pytest.mark.parametrize("split", ["256", "4096", "128m"])
def test_round_trip_with_magic_inside_payloads(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pages = spark.createDataFrame(ROWS[:-2] if split == "256" else ROWS, SCHEMA).coalesce(2)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((tuple(r) for r in warc.warc_report(pages).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == brute(ROWS[:-2] if split == "256" else ROWS)


def test_small_payloads_are_not_revisited(spark):
    rows = [(1, "u", "abc", "s"), (2, "u", "abc", "s"), (3, "u", "longer text", "s"), (4, "u", "longer text", "s")]
    got = sorted((tuple(r) for r in warc.warc_report(spark.createDataFrame(rows, SCHEMA), least=4).collect()), key=repr)
    assert got == brute(rows, least=4)


def test_empty_table(spark):
    assert warc.warc_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_follow_the_format(spark):
    path = fresh_path(spark, "warc-format")
    warc.write_warc(spark.createDataFrame(ROWS[:4], SCHEMA).coalesce(1), path)
    content = spark.read.format("binaryFile").load(path).filter(F.length("content") > 0).first().content
    at, types = 0, []
    while at < len(content):
        assert content[at:].startswith(b"WARC/1.1\r\n")
        head, _, rest = content[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        at += len(head) + 4 + int(fields[b"Content-Length"]) + 4
        types.append(fields[b"WARC-Type"].decode())
    assert at == len(content) and sorted(types) == ["response", "response", "revisit", "revisit"]
