import random
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int, n int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts(rows, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    return f, n


def plain(rows, least, top, longest=5):
    f, n = counts(rows, longest)
    f = {k: v for k, v in f.items() if v >= least}
    best = {}
    inside = Counter()
    for (lang, p), v in f.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], v)
    for (lang, p), a in f.items():
        if len(p) > 1 and inside[lang, p] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, found in best.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    pool = ["The", "cat", "dog\x01", "sat", "on", "é€", "𝄞", "a", "New York City", "once upon a time", "x\x1fy"]
    text = lambda: "".join(rng.choice(pool) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", " \r"]) for _ in range(rng.randint(0, 40)))
    return [(i, text(), rng.choice(["en", "en", "fr", None, "und"]), "p", 1, 1) for i in range(n)]


EDGES = [(1, None, "en", None, None, None), (2, "", None, "x", 1, 1), (3, " .,;\t\n", "en", "x", 1, 1), (None, "new york city " * 20, None, "x", 1, 1), (None, "new york city " * 20, None, "x", 1, 1),
         (4, "word " * 3000 + "x" * 100_000, "de", "x", 1, 1), (5, " ".join(f"w{i % 700}" for i in range(20_000)), "de", "x", 1, 1)]
OPTIONS = [{}, {"bucket": 200}, {"bucket": 60, "bounds": 7}]


@pytest.mark.parametrize("options", OPTIONS, ids=["one-bucket", "buckets", "deals"])
@pytest.mark.parametrize("rows", [made(1), made(2, 40) + EDGES, EDGES[:3], []], ids=["made", "edges", "no-words", "empty"])
def test_phrases_equal_plain_counts(spark, monkeypatch, options, rows):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 700)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), top=40, least=9, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 9, 40)


def test_counts_of_all_frequent_phrases(spark):
    rows = made(3)
    phrases, totals = collocations.frequent_phrases(spark.createDataFrame(rows, SCHEMA), least=5, bucket=300)
    f, n = counts(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in phrases.collect()} == {k: v for k, v in f.items() if v >= 5}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


@pytest.mark.parametrize("backwards", [False, True])
def test_cut_streams_equal_one_scan(spark, backwards):
    phrases, _ = collocations.frequent_phrases(spark.createDataFrame(made(4), SCHEMA), least=4)
    whole = collocations.stream(phrases, backwards).collect()
    assert all(r.own for r in whole)
    cut = collocations.stream(phrases, backwards, rows=15).collect()
    key = lambda r: (r.lang, r.phrase)
    assert len({key(r) for r in cut}) == sum(r.own for r in cut) == len(whole) < len(cut)
    own = {key(r): (r.f, r.counts) for r in cut if r.own}
    assert own == {key(r): (r.f, r.counts) for r in whole}
    assert {key(r) for r in cut if r.covered} == {key(r) for r in whole if r.covered}


def test_lowest_cut_is_exact_beyond_64_bits():
    a, n = 10**15 + 1, 10**18 + 7
    assert collocations.lowest_cut(a, n, [10**15 + 3, 10**16], [10**15 + 5, 10**15 + 9]) == (1000 * a * n // ((10**16) * (10**15 + 5)), 10**16, 10**15 + 5)
    assert collocations.lowest_cut(10, 8, [20, 40, 20], [20, 40, 20]) == (1000 * 80 // 1600, 40, 40)
    assert collocations.lowest_cut(10, 8, [20, 40], [20, 40]) == (1000 * 80 // 800, 20, 40)  # the first of equal scores


def test_order_of_wide_columns():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, high, 500) for high in (2, 1 << 40, 3, 1 << 40, 5, 2)]
    order, new = collocations._order(columns)
    rows = list(zip(*(c.tolist() for c in columns)))
    assert [rows[i] for i in order] == sorted(rows) and new.sum() == len(set(rows))
