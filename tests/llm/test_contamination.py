import hashlib
import random
import re

import pytest

from palimpsest.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k:k + size]))
                if ids:
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "X1"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.randint(1, 40))) for i in range(25)]
    docs = []
    for i in range(80):
        w = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(items)[1]
            a = rng.randint(0, max(len(piece) - 13, 0))
            w[len(w) // 2:len(w) // 2] = piece[a:a + rng.randint(10, 20)]
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(w)))
    docs += [(100, None), (101, ""), (102, "..."), (103, docs[3][1]), (103, docs[3][1]), (None, " ".join(items[2][1])), (104, "w1 " * 30000)]
    items = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, "!"), (None, "w1 w2 w3"), (52, "w1 w1 w1"), (53, "w1 w1 w1")]
    return docs, items


@pytest.mark.parametrize("query_words", [10**6, 60])
def test_hits_agree_with_brute_force(spark, query_words):
    docs, items = tables(3)
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination.contamination_report(frame, bench, query_words=query_words).collect()), key=repr)
    assert got == brute(docs, items)


def test_many_candidates_are_taken_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "CHUNK", 50)
    docs, items = tables(4)
    got = sorted((tuple(r) for r in contamination.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == brute(docs, items)


def test_proximity_lets_words_stand_a_little_off(spark):
    item = [(1, "alpha beta gamma delta")]
    docs = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x x x beta gamma delta"), (4, "beta alpha gamma delta")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")
    found = lambda slop: {r.doc_id for r in contamination.documents_hit(frame, bench, slop=slop).collect() if r["items"]}
    assert found(0) == {1} and found(1) == {1, 2} and found(2) == {1, 2, 4} and found(3) == {1, 2, 3, 4}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination.contamination_report(docs, none).collect()] == [(1, 2, 0, 0)]
    assert contamination.contamination_report(docs.limit(0), none).collect() == []
