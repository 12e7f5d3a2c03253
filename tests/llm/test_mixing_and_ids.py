import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import binary_ids, mixing
from palimpsest.llm.encoding import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, size string, target int"


# --- mixing ---------------------------------------------------------------------------------------------------

def plain_targets(sizes, most=3):
    """Share again and again until nothing is above its bound."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > sizes[s] * most}
        if not full:
            return target | share
        target |= {s: float(sizes[s] * most) for s in full}
        open_ -= full
    return target


def corpus(seed, sources, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(sources), "x", 1) for i in range(n)]
    return rows + [(1000, None, sources[0], None, None), (1001, "  \n", None, "x", 1), (1002, "w " * 5000, sources[-1], "x", 1), (5, "w w w", sources[0], "x", 1), (None, "w w", sources[0], "x", 1)]


@pytest.mark.parametrize("options", [{}, {"block_words": 200, "shard_words": 500}, {"block_words": 1, "shard_words": 100}])
def test_sources_reach_their_targets(spark, options):
    rows = corpus(1, ["a", "b", "é", "zz"] * 5 + ["rare", None])
    report = mixing.mix_report(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()
    count = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want, taken = plain_targets(sizes), {}
    source_of = {(i, count(t)): s for i, t, s, *_ in rows}
    for r in report:
        s = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(want[s], 1)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert len(report) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_shards_are_disjoint_whole_and_even(spark):
    docs = spark.createDataFrame(corpus(2, list("abcde")), SCHEMA)
    options = {"block_words": 50, "shard_words": 600}
    rows, taken = mixing.mix(docs, **options)
    got = taken.collect()
    assert len({(r["_row"], r["pass"]) for r in got}) == len(got)
    words = rows.select("source", "target").distinct().agg(F.sum("target")).first()[0]
    assert abs(sum(r.words for r in got) - words) <= 5
    shards = {}
    for r in got:
        shards[r.shard] = shards.get(r.shard, 0) + r.words
    assert len(shards) > 8
    again = mixing.mix(docs, **options)[1].collect()
    assert sorted((r["_row"], r["pass"], r.shard, r.place) for r in got) == sorted((r["_row"], r["pass"], r.shard, r.place) for r in again)


def test_hypergeometric_draws_have_the_right_distribution(spark):
    draws = spark.range(20000).select(mixing._hypergeometric((F.col("id") + 0.5) / 20000, F.lit(30).cast("bigint"), F.lit(12).cast("bigint"), F.lit(10).cast("bigint")).alias("x"))
    got = {r.x: r["count"] / 20000 for r in draws.groupBy("x").count().collect()}
    from math import comb
    for k in range(11):
        assert abs(got.get(k, 0) - comb(12, k) * comb(18, 10 - k) / comb(30, 10)) < 2e-4


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(i, f" a{i}  b{i}\nc{i} ", "s" if i < 8 else "t", "x", 1) for i in range(12)], SCHEMA)
    out = mixing.mixed(docs, block_words=4).collect()
    report = {r.doc_id: r for r in mixing.mix_report(docs, block_words=4).collect()}
    for i, r in report.items():
        texts = [x.text for x in out if x.doc_id == i]
        assert sum(len(t.split()) for t in texts) == r.taken
        assert all(f" a{i}  b{i}\nc{i} ".startswith(t) for t in texts)


def test_empty_mix(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_report(empty).collect() == [] and mixing.mixed(empty).collect() == []
    nothing = spark.createDataFrame([(1, "", "a", "x", 1), (2, None, "b", "x", 1)], SCHEMA)
    assert sorted(tuple(r) for r in mixing.mix_report(nothing).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix_report(spark.createDataFrame([(1, "a", "s", "x", 1)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- token ids ------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH), Encoder(PATH)


@given(st.lists(st.text(alphabet="abzAZ09 \t\n.,'!-<|>éÉ́»…İΣσßſK中٠​\x00\x1c '", max_size=25), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(tools, texts):
    library, encoder = tools
    texts = [*texts, "it's I'LL they'd 'sfoo a'.b !'s", "a<|endoftext|>b <|ENDOFTEXT|>", None]
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    cuts = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[cuts[i]:cuts[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=200, deadline=None)
def test_packing_round_trip(values):
    ranks = np.array(values, np.uint32)
    assert (binary_ids.unpack(*binary_ids.pack(ranks), len(ranks)) == ranks).all()


def test_frames_rank_by_frequency():
    ids = np.array([7] * 300 + list(range(1000, 1400)) + [9] * 50)
    raw = binary_ids.frame_bytes(3, 4, pa.array([1, None], pa.int64()), np.array([700, 50]), ids)
    (part, number, docs, missing, counts, back), = binary_ids.frames(memoryview(raw + b"\n"))
    assert (part, number, counts.tolist(), missing.tolist()) == (3, 4, [700, 50], [False, True]) and (back == ids).all()
    table = np.frombuffer(raw, "<u4", 2, 8 + 48 + 2 * 8 + 2 + 2 * 8)
    assert table.tolist() == [7, 9]


@pytest.mark.parametrize("frame_ids", [50, 4_000_000])
def test_files_hold_all_ids_in_order(spark, tools, frame_ids):
    library, _ = tools
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["The", "cat's", "straße", "12", "x,y"]) for _ in range(rng.randint(0, 30)))) for _ in range(60)]
    rows += [(-5, None), (-4, ""), (None, "no id"), (17, "same"), (17, "same"), (18, "long " * 30000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(4)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_ids.ids_report(docs, PATH, frame_ids=frame_ids).collect()))
    assert [g[1] for g in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    start, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for at, i, n, crc in got:
        ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[i]]
        assert at == start and any(len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc for x in ids)
        start += n
    assert binary_ids.ids_report(docs.limit(0), PATH).collect() == []
