import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([1, 2, 3, 5, 16, 20]), st.integers(1, 9), st.sampled_from(["int32", "int64", "object"]))
@settings(max_examples=120, deadline=None)
def test_nearest_is_exact_and_takes_the_lower_of_ties(seed, n, width, entries, kind):
    rng = np.random.default_rng(seed)
    rows, book = rng.integers(-4, 5, (n, width)).astype(kind), rng.integers(-4, 5, (entries, width)).astype(kind)
    if kind == "object":
        rows, book = rows * 10**30, book * 10**30
    size = vector_codes.transform(rows).shape[1]
    index, scaled = vector_codes.nearest(vector_codes.transform(rows), vector_codes.transform(book))
    all_ = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, b)) for b in book] for r in rows]
    assert index.tolist() == [d.index(min(d)) for d in all_]
    assert [int(s) for s in scaled] == [size * min(d) for d in all_]


@pytest.mark.parametrize("size", [1, 2, 4, 8, 32])
def test_coefficients_come_by_sign_changes(size):
    basis = vector_codes.transform(np.eye(size, dtype=np.int64)).T
    assert [int((np.diff(b) != 0).sum()) for b in basis] == list(range(size))


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) if abs(x) < 2**40 else int(np.float32(x)) * 1024 for x in v], label) for i, v, label, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(best(v, p)[1], []).append(part(v, p))
            for k, members in of.items():
                new[p][k] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts)), label) for i, v, label in kept]
    totals = {}
    for *_, e, label in out:
        totals[label] = totals.get(label, 0) + e
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, c, long(e), long(totals[label]), digest) for i, c, e, label in out), key=repr)


def made(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(width)], rng.choice([0, 1, 2, None]), "x", 7) for i in range(n)]


EDGES = [(900, None, 1, None, None), (901, [0.5, None, 0.1], 1, "x", 1), (902, [float("nan")] * 8, 1, "x", 1), (903, [float("inf")] + [0.0] * 7, None, "x", 1),
         (None, [0.25] * 8, None, "x", 1), (None, [-0.25] * 8, None, "x", 1), (5, [0.25] * 8, 1, "x", 1), (5, [0.25] * 8, 1, "x", 1), (904, [], 2, "x", 1), (905, [1.0, -1.0], 2, "x", 1)]


@pytest.mark.parametrize("rows", [made(1, 400, 64), made(2, 60, 8) + EDGES, made(3, 30, 10), EDGES, made(4, 40, 8, 1e5), made(5, 40, 8, 1e30), EDGES[:4], []],
                         ids=["many", "edges", "uneven", "only-edges", "wide", "huge", "none-kept", "empty"])
def test_report_equals_plain_rounds(spark, rows):
    got = vector_codes.compression_report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_sums_of_many_tasks_stay_exact(spark):
    rows = [(i, [3e4, -3e4, 2e4, -1e4], 0, "x", 1) for i in range(3000)] + [(-1, [0.0] * 4, 0, "x", 1)]
    got = vector_codes.compression_report(spark.createDataFrame(rows, SCHEMA).repartition(16), entries=2, rounds=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, entries=2, rounds=2)


def test_integers_of_32_bits_hold_unit_vectors():
    layout = vector_codes._layout(64, 1.0, 4, 1024)
    assert layout.kind == "int32" and layout.part == 16
    assert vector_codes.integers(pa.array([[-0.0001] * 64], pa.list_(pa.float32())), layout, 1024).tolist() == [[-1] * 64]
    assert "op11_vector_codes" in queries.ORACLES
