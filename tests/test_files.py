"""CSV files as they come: headers by file, quoted line ends over splits, row numbers."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import corpus, files


def table(rng, n):
    cell = lambda: "".join(rng.choice(['a', 'b', ' ', ',', '"', '\n', "'", 'é', ';', '\r\n']) for _ in range(rng.randint(0, 12)))
    return [[cell(), str(rng.randint(0, 1)), str(i // 3), cell() + "x"] for i in range(n)]


def write(path, header, rows, end="\n", blank=False):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        for i, row in enumerate(rows):
            out.writerow(row)
            if blank and i % 3 == 0:
                f.write(end)


def same(text):
    return None if text in corpus.NULL_TOKENS else text


@pytest.fixture
def narrow(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "211")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_files_of_any_order_over_many_splits(narrow, tmp_path, seed):
    rng = random.Random(seed)
    shapes = {"M_train_original_sentences.csv": (["Text", "Label", "doc_ID", "AdvText"], [0, 1, 2, 3]), "M_test_obfuscated_KB_sentences.csv": (["doc_ID", "AdvText", "extra", "Class", "Text"], [2, 3, 0, 1, 0]),
              "deep/M_val_original.csv": ([" Label", "Text "], [1, 0])}
    want = []
    (tmp_path / "deep").mkdir()
    for k, (name, (header, order)) in enumerate(shapes.items()):
        rows = table(rng, rng.randint(0, 60))
        write(tmp_path / name, header, [[r[j] for j in order] for r in rows], end=["\n", "\r\n", "\n"][k], blank=k == 1)
        split = name.split("_")[1]
        for at, r in enumerate(rows):
            full = k < 2
            want.append((same(r[0]), same(r[3]) if full else None, int(r[1]), int(r[2]) if full else None, at, split))
    got = corpus.import_legacy(narrow, str(tmp_path), "s").select("Text", "AdvText", "Label", "doc_ID", "sent_id", "split")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_cell_longer_than_many_splits(narrow, tmp_path):
    long = "line of text\n" * 2000 + 'and a "quote"'
    write(tmp_path / "a.csv", ["Text", "Label"], [["first", "0"], [long, "1"], ["last", "0"]])
    rows = {r.sent_id: r for r in corpus.read_legacy(narrow, str(tmp_path / "a.csv"), "sentences").collect()}
    assert sorted(rows) == [0, 1, 2] and rows[1].Text == long and rows[2].Text == "last" and rows[1].Label == 1


def test_defined_cases(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("Text,Label\n")
    (tmp_path / "open.csv").write_text('﻿Text,Label\nok,1\n"never closed,0\nmore')
    (tmp_path / "ragged.csv").write_text("\n\nText,Label,Text\nonly\na,1,b,c\n\r\n,NaN\n")
    rows = corpus.read_legacy(spark, str(tmp_path), "sentences").select(F.regexp_extract("file", "([a-z]+).csv$", 1).alias("f"), "row", "Text", "Label").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([("open", 0, "ok", 1), ("open", 1, "never closed,0\nmore", None), ("ragged", 0, "only", None), ("ragged", 1, "a", 1), ("ragged", 2, None, None)], key=repr)


def test_rows_that_stay_in_a_split_are_not_dealt(spark, tmp_path):
    write(tmp_path / "a.csv", ["Text"], [["x\ny"]] * 50)
    assert files.split_offsets(files._lines(spark, str(tmp_path))).collect()[0].first == 0
    rows, headers = files.read_files(spark, str(tmp_path))
    assert rows.count() == 50 and [r.names for r in headers.collect()] == [["Text"]]


def test_own_row_keys_are_kept(spark, tmp_path):
    write(tmp_path / "a.csv", ["sent_id", "Text"], [["7", "a"], ["", "b"]])
    assert [(r.sent_id, r.Text) for r in corpus.read_legacy(spark, str(tmp_path), "sentences").orderBy("row").collect()] == [(7, "a"), (1, "b")]
