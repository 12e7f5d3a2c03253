import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import jaccard
from palimpsest.llm.components import components
from palimpsest.llm.tokens import Block

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, class string, n int, token string"


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def brute(rows, percent=75):
    sets, where = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in sets.items():
        met = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j > i:
                    met[j] += 1
        for j, same in met.items():
            if 100 * same >= percent * (len(s) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 70))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(w)
    passage = [rng.choice(words) for _ in range(40)]  # shared by many, similar by some
    texts += [passage + [rng.choice(words) for _ in range(rng.randint(5, 20))] for _ in range(40)]
    rows = [(i * 3 + 1, " ".join(w).upper() if i % 7 == 0 else " \n".join(w)) for i, w in enumerate(texts)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a"), (9004, "A"), (9005, "a b"), (9006, "x " * 30000), (9007, "x " * 20000)]
    rng.shuffle(rows)
    return rows


def test_components_agree_with_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_hot_lists_are_salted_and_still_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", -10**9)
    rows = corpus(2)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text), (2, text + " eight"), (None, None)]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 3, 2), (5, 3, 2), (None, 3, 2), (2, 4, 2), (None, 0, None)], key=repr)
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_without_an_id_link_their_neighbours(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(words[a:b])
    # the first and last are similar to the null-id text between them only, and the fourth is a null-id text near a null-id one
    rows = [(7, text(0, 44)), (None, text(4, 48)), (3, text(8, 52)), (None, "a b c d e f g h i j k l m n o"), (None, "b c d e f g h i j k l m n o"), (9, "x y z")]
    assert jaccard.near_duplicates(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).select("component_id").distinct().count() == 2
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(7, 40, 3), (None, 40, 3), (3, 40, 3), (None, 11, None), (None, 10, None), (9, 1, 9)], key=repr)


@pytest.mark.parametrize("n", range(1, 120))
def test_prefix_meets_every_similar_set(n):
    """Two sets at the bound share an item of both prefixes, whatever the order."""
    prefix = jaccard._prefix(np.array([0, n]), 75)[0]
    assert n - prefix + 1 == -(-n * 75 // 100)  # what is behind the prefix is too small to be the whole overlap


def test_orders_break_ties_by_the_whole_hash():
    value = np.arange(1, 50, dtype=np.uint64)
    text = np.zeros(49, np.int64)
    order = jaccard._ranked(text, value, np.zeros(49, np.int32), 7, 1)
    again = jaccard._ranked(text, value[::-1].copy(), np.zeros(49, np.int32), 7, 1)
    assert value[order].tolist() == value[::-1][again].tolist()


def test_sets_do_not_depend_on_neighbours():
    alone = jaccard.sets_of(Block(pa.array(["a b c d e f"])))
    among = jaccard.sets_of(Block(pa.array(["z", "a b c d e f", None, "q r s t u v w"])))
    assert alone[2][0] == among[2][1] and len(set(among[2])) == 4


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = dict((r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 60)} == {1} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signatures_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    for kept in (0, 1, 150, 290, 300):
        other = np.concatenate([base[:kept], rng.integers(1, 1 << 62, 40, dtype=np.uint64)])
        a, b = jaccard.signatures(np.array([0, 300, 300, 340 + kept]), np.concatenate([base, other]))[[0, 2]]
        differing = sum(int(x ^ y).bit_count() for x, y in zip(a.view(np.uint64), b.view(np.uint64)))
        assert differing <= 300 - kept + 40 and differing % 2 == (300 - kept + 40) % 2
    assert not jaccard.signatures(np.array([0, 0]), np.zeros(0, np.uint64)).any()


def test_unlike_members_of_a_list_make_no_pairs(spark):
    """A list of n classes that share one shingle gave n (n - 1) / 2 pairs to verify."""
    rng = np.random.default_rng(6)
    sets = rng.integers(1, 1 << 62, (200, 40), dtype=np.uint64)
    sets[:, 0] = 7
    sets[199] = sets[0]
    sets[199, 39] = 8   # 39 of 41
    signs = jaccard.signatures(np.arange(201) * 40, sets.ravel())
    signed = spark.createDataFrame([(i, 40, *map(int, s)) for i, s in enumerate(signs)], "class long, n long, " + ", ".join(f"{c} long" for c in jaccard.SIGNS))
    lists = spark.createDataFrame([(7, i, 40, 0, i) for i in range(200)], "token long, class long, n int, at int, comp long")
    assert [tuple(r) for r in jaccard.crossing_pairs(lists, signed, 75, 3).collect()] == [(199, 0)]
    pairs = spark.createDataFrame([(199, 0), (5, 4), (3, 2)], "a long, b long")
    assert [tuple(r) for r in jaccard.close_pairs(pairs, signed, 75).collect()] == [(199, 0)]


def test_a_class_meets_several_members_of_its_lists(spark):
    """Each class met one member of one list, so a large group of near copies stayed in many components, whose pairs were all made."""
    shared = np.arange(1, 41, dtype=np.uint64)
    sets = np.tile(shared, (24, 1))
    signs = jaccard.signatures(np.arange(25) * 40, sets.ravel())
    signed = spark.createDataFrame([(i, 40, *map(int, s)) for i, s in enumerate(signs)], "class long, n long, " + ", ".join(f"{c} long" for c in jaccard.SIGNS))
    lists = spark.createDataFrame([(t, i, 40, 0, i) for t in (7, 8) for i in range(24)], "token long, class long, n int, at int, comp long")
    pairs = [tuple(r) for r in jaccard.star_pairs(lists, signed, 75, 1).collect()]
    assert len(pairs) == len(set(pairs)) and all(a > b for a, b in pairs)
    met = defaultdict(set)
    for a, b in pairs:
        met[a].add(b)
        met[b].add(a)
    assert len(met) == 24 and min(map(len, met.values())) > 2 and len(pairs) < 24 * 23 / 2


def test_lists_with_the_same_members_are_one(spark):
    """Near copies share most of their shingles: each of these gave all pairs of the list again."""
    place = {50: 2, 60: 0, 70: 5}
    rows = [(t, c, 40, at + c, 2, 40, 0, 3) for t, at in place.items() for c in (1, 2, 3)] + [(80, 1, 40, 9, 1, 40, 9, 2), (80, 3, 40, 9, 1, 40, 9, 2), (90, 1, 40, 9, 1, 40, 9, 2), (90, 2, 40, 9, 1, 40, 9, 2)]
    lists = spark.createDataFrame(rows, "token long, class long, n int, at int, centre long, m int, mat int, size int")
    got = jaccard.open_lists(lists, spark.createDataFrame([(2, 1)], "a long, b long"))
    # list 90 lies in one component; 60 stands for 50 and 70, as its shingle is first in the order
    assert sorted((r.token, r["class"], r.at, r.comp) for r in got.collect()) == [(60, 1, 1, 1), (60, 2, 2, 1), (60, 3, 3, 3), (80, 1, 9, 1), (80, 3, 9, 3)]
