"""Hashes of words, and what they decide."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import encoding, jaccard, lm, quality
from palimpsest.llm.tokens import Block, factorize

public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


PAIR = thue_morse(1024), thue_morse(1024, "b", "a")  # equal under any polynomial modulo 2^64


def test_words_that_polynomials_confuse_differ():
    for a, b in (PAIR, (thue_morse(2048), thue_morse(2048, "b", "a")), (PAIR[0][:500], PAIR[1][:500])):
        _, _, h, _ = Block(pa.array([f"{a} {b} {a.upper()}", f"x {b}"])).words()
        assert h[0] != h[1] and h[0] == h[2] and h[1] == h[4]


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=30), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_equal_bytes_give_equal_hashes_wherever_they_stand(texts, shift):
    block = Block(pa.array(["." * shift + t for t in texts], pa.string()))
    starts, ends = block.bounds[:-1] + shift, block.bounds[1:]
    got = dict(zip((t.encode() for t in texts), block.word_hashes(starts, ends)))
    again = Block(pa.array(texts, pa.string()))
    assert [got[t.encode()] for t in texts] == again.word_hashes(again.bounds[:-1], again.bounds[1:]).tolist()
    assert len({int(v) for v in got.values()}) == len(got)


def test_ids_of_such_words_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, counts = encoding.Encoder(path).encode(pa.array([f"{PAIR[0]} x", f"{PAIR[1]} x"]))
    want = [Tokenizer.from_file(path).encode(f"{p} x", add_special_tokens=False).ids for p in PAIR]
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0] and np.split(ids, np.cumsum(counts)[:-1])[1].tolist() == want[1]


def test_ids_above_16_bits_are_kept():
    known = encoding._Known()
    h = np.array([3, 1, 2], np.uint64)
    known.add(h, np.array([70_000, 5, 1 << 20, 7], np.int64), np.array([1, 1, 2]))
    where, found = known.find(h)
    assert found.all() and [known.ids[a:a + n].tolist() for a, n in zip(known.at[where], known.n[where])] == [[70_000], [5], [1 << 20, 7]]


def test_lines_and_shingles_of_such_words_differ(spark):
    counted = quality.counts_of(Block(pa.array([f"{PAIR[0]}\n{PAIR[1]}\n{PAIR[0]}"])))
    assert counted["n_dup_lines"].tolist() == [1]
    docs = spark.createDataFrame([(1, PAIR[0]), (2, PAIR[1]), (3, PAIR[0])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_factorize_keeps_the_order_of_first_occurrence():
    codes, distinct = factorize(np.array([7, 3, 7, 9], np.uint64))
    assert codes.tolist() == [0, 1, 0, 2] and distinct.tolist() == [7, 3, 9]
    assert [len(x) for x in factorize(np.zeros(0, np.uint64))] == [0, 0]


def test_counts_of_such_words_differ():
    assert lm is not None and len(set(Block(pa.array([" ".join(PAIR)])).words()[2].tolist())) == 2
