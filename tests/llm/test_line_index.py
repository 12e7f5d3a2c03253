import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import line_index
from palimpsest.llm.cuckoo import Cuckoo

SCHEMA = "doc_id long, text string, key string, shard int, present int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def digests(numbers):
    return np.frombuffer(b"".join(hashlib.blake2b(str(n).encode(), digest_size=16).digest() for n in numbers), np.uint8).reshape(-1, 16)


@given(st.integers(0, 10**6), st.integers(1, 3000), st.integers(0, 200))
@settings(max_examples=40, deadline=None)
def test_cuckoo_never_reports_too_few(seed, n, start):
    rng = np.random.default_rng(seed)
    want = rng.integers(0, 3, n)
    cuckoo = Cuckoo.sized(start)  # too small in most runs: the rest goes to the short list
    keys = digests(range(n))
    if n > 4 * cuckoo.room:
        cuckoo = Cuckoo.sized(n)
    for t in (1, 2):
        cuckoo.add(keys[want >= t])
    assert cuckoo.items == want.sum() and (cuckoo.copies(keys) >= want).all()
    again = Cuckoo(cuckoo.buckets, cuckoo.slots.tobytes(), cuckoo.stash.tobytes())
    gone = rng.integers(0, want + 1)
    for t in (1, 2):
        again.remove(keys[gone >= t])
    assert again.items == (want - gone).sum() and (again.copies(keys) >= want - gone).all()
    for t in (1, 2):
        again.remove(keys[want - gone >= t])
    assert again.items == 0


def test_a_filter_of_its_size_reports_few_strangers():
    cuckoo = Cuckoo.sized(100_000)
    cuckoo.add(digests(range(100_000)))
    assert not len(cuckoo.stash) and (cuckoo.copies(digests(range(100_000, 200_000))) > 0).mean() < 0.001


def plain(rows, held=None):
    """Reported documents, by the documents the index holds."""
    key = lambda line: (lambda k: k if len(k) >= 10 else None)(line.strip(" \t\n\x0b\x0c\r").translate(LOW))
    holders = {}
    for i, t, *_ in rows if held is None else held:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        first = lambda k: min(holders[k], key=lambda x: (x is None, x or 0))
        kept = [x for x in lines if key(x) is None or len(holders.get(key(x), [])) < 2 or first(key(x)) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, ids):
    rng = random.Random(seed)
    pool = [f"Line number {k} says" for k in range(30)] + ["short", "ÄÖÜßé€𝄞xyz", "ÄÖÜßé€𝄞x", "A COMMON LINE HERE "]
    return [(i, "\n".join(rng.choice([str.upper, str.lower, lambda s: f"\t {s}\x0b", str])(rng.choice(pool)) for _ in range(rng.randint(0, 8))) + rng.choice(["", "\n", "\na common line here"]), "k", 1, 0) for i in ids]


EDGES = [(1, None, None, None, None), (2, "", "k", 1, 1), (3, "\n\n", "k", 1, 1), (None, "a common line here\nown line of nobody", "k", 1, 1), (None, "own line of nobody", "k", 1, 1),
         (7, "a common line here", "k", 1, 1), (7, "a common line here\na common line here", "k", 1, 1), (8, "x" * 300_000 + "\na common line here", "k", 1, 1), (-5, "A Common Line Here\r", "k", 1, 1)]


@pytest.mark.parametrize("rows", [made(1, range(200)), EDGES, made(2, range(20)) + EDGES, [(1, None, None, None, None)], []], ids=["many", "edges", "both", "null", "empty"])
def test_report_equals_plain(spark, rows):
    got = line_index.line_report(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_keys=16)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def reported(index, spark, rows):
    got = index.report(spark.createDataFrame(rows, SCHEMA))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=repr)


def state(index):
    return sorted((tuple(r) for r in index.counts().collect()), key=repr)


def test_documents_come_and_go(spark):
    first, second, third = made(1, range(0, 60, 2)), made(2, range(1, 60, 2)), made(3, range(100, 400))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    one = line_index.empty_index(frame(first), shard_keys=16).insert(frame(first))
    two = one.insert(frame(second))
    three = two.insert(frame(third))
    assert reported(one, spark, first) == plain(first)
    assert reported(two, spark, first + second) == plain(first + second)
    assert reported(three, spark, first + second + third) == plain(first + second + third)
    assert state(two.insert(frame(second))) == state(two)  # again
    back = three.delete(frame(third).union(frame([(12345, "unknown", "", 0, 0)])))
    assert state(back) == state(two) and reported(back, spark, first + second) == plain(first + second)
    items = lambda index: index._filters().selectExpr("sum(items)").first()[0]
    assert items(back) == items(two)
    late = back.delete(frame(first)).insert(frame(third))
    assert reported(late, spark, second + third) == plain(second + third)
    nothing = late.delete(frame(second + third))
    assert state(nothing) == [] and items(nothing) == 0
    assert reported(nothing.insert(frame(first)), spark, first) == plain(first)
    assert state(one) == state(line_index.empty_index(frame(first)).insert(frame(first)))  # older indexes stay as they were


def test_filters_and_shards_grow(spark):
    few, many = [(i, f"the line of document {i}", "", 0, 0) for i in range(20)], [(i, f"the line of document {i % 900}", "", 0, 0) for i in range(20, 1500)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    small = line_index.empty_index(frame(few), shard_keys=1000).insert(frame(few))
    grown = small.insert(frame(many))  # one shard whose filter runs full
    assert grown.bits == 1 - 1 and grown._filters().count() == 1 and reported(grown, spark, few + many) == plain(few + many)
    dealt = line_index.empty_index(frame(few), shard_keys=20).insert(frame(few)).insert(frame(many))
    assert dealt.bits > 4 and dealt._filters().count() > 16 and reported(dealt, spark, few + many) == plain(few + many)


def test_exact_counts_are_read_for_few_keys_only(spark):
    rows = [(i, f"a line that only document {i} has\none that all have", "", 0, 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = line_index.empty_index(docs, shard_keys=500).insert(docs)
    keys = line_index.keys_of(docs).select("key").distinct()
    assert index.known(keys).count() == 3001 and 1 <= index.known(keys, 2).count() < 10
    new = line_index.keys_of(spark.createDataFrame([(9, f"a stranger's line of number {i}", "", 0, 0) for i in range(3000)], SCHEMA)).select("key").distinct()
    assert index.known(new).count() < 10
