import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import substrings
from palimpsest.llm.suffixes import suffix_array


@given(st.lists(st.integers(0, 4), max_size=40))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(rows, length=200):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark, end = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                mark[max(end, k):k + length] = b"\1" * (k + length - max(end, k))
                end = k + length
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, al="abcdé ": "".join(rng.choice(al) for _ in range(n))
    passages = [text(rng.randint(150, 700)) for _ in range(10)]
    rows = []
    for _ in range(90):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 60) if rng.random() < 0.5 else 0
            z = len(p) - (rng.randint(0, 60) if rng.random() < 0.5 else 0)
            t += text(rng.randint(0, 120), "xyz") + p[a:z]
        rows.append(t + text(rng.randint(0, 50)))
    rows += ["a" * 500, "a" * 230, "ab" * 300, "abc" * 90, None, "", rows[3], rows[3], rows[7], text(199), text(200), "q" * 199, "q" * 199, "z" * 200, "z" * 200, "\0" * 260]
    return list(enumerate(rows)) + [(3, rows[3]), (None, rows[5])]


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"grouped": 7}])
def test_removed_bytes_agree_with_brute_force(spark, options):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, core int, key string").repartition(5)
    got = sorted((tuple(r) for r in substrings.substring_report(docs, **options).collect()), key=repr)
    assert got == brute(rows)


def test_small_batches_give_the_same(spark):
    """Runs of cores that go over many Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = corpus(6)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = sorted((tuple(r) for r in substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows)


def test_empty_table(spark):
    assert substrings.substring_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
