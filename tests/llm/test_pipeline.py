import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import language
from palimpsest.workspace import stored
from tests.llm.test_contamination import brute as hit_words
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_mixing_and_ids import WORD, plain_targets

SF = "/root/testdata/sf0.001"
LETTER = re.compile(r"[^\W\d_]")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), "test-stage")
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_language(stages):
    before, after = stages["language"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before if LETTER.search(r.text or "")}
    assert len(after) >= 0.95 * len(before) and after[0].asDict().keys() == before[0].asDict().keys()


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want = {i for i, _, c in linked([(r.doc_id, r.text) for r in before]) if i == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before)


def test_contamination(stages, spark):
    before, after = stages["contamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0] for r in hit_words([(r.doc_id, r.text) for r in before], items) if not r[5]}
    assert {r.doc_id for r in after} == want and len(want) < len(before)


def test_mixing(stages):
    before, after = stages["mixing"]
    size = lambda t: len(WORD.findall(t or ""))
    sizes, got = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in after:
        got[r.source] = got.get(r.source, 0) + size(r.text)
        assert r.n_chars == len(r.text)
    for s, target in plain_targets(sizes).items():
        assert abs(got.get(s, 0) - target) <= 0.5


def test_token_ids(stages):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages["token_ids"]
    want = sorted((r.doc_id, zlib.crc32(np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in before)
    assert sorted((r.doc_id, r.ids_crc32) for r in after) == want
    assert sum(r.n_tokens for r in after) == max(r.start + r.n_tokens for r in after)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, key string"
ROWS = [(1, "the cat and the dog " * 5, "en", "a", 100, 1, "k"), (1, "the cat and the dog " * 5, "en", "a", 100, 1, "k"), (None, "the cat went over to that house", None, None, None, None, None),
        (3, None, "en", "a", 0, 1, "k"), (4, "", None, "b", 0, 1, "k"), (5, "w " * 20000, "en", "b", 40000, 1, "k"), (6, "der Hund und die Katze", "de", "b", 22, 1, "k")]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_defined_cases(spark, name, stage):
    docs = stored(spark.createDataFrame(ROWS, SCHEMA), "cases")
    rows = stage(spark, docs, SF).collect()
    if name == "language":
        assert sorted((r.doc_id for r in rows), key=repr) == sorted([1, 1, None, 5, 6], key=repr)
    if name == "near_duplicates":
        assert sorted((r.doc_id for r in rows), key=repr) == sorted([1, None, 3, 4, 5, 6], key=repr)
    if name == "contamination":
        assert len(rows) == len(ROWS)
    if name == "token_ids":
        assert len(rows) == len(ROWS)
    if name != "token_ids":
        assert all(len(r) == 7 for r in rows)
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_a_clean_text_in_three_languages_stays(spark):
    words = {"en": "the cat and dog went over to that house", "de": "der Hund und die Katze gingen über das Haus", "fr": "le chat et les chiens vont dans cette maison"}
    rows = [(10 * i + k, f"{text} " * 4, lang, "a", 0, 1, "k") for k, (lang, text) in enumerate(words.items()) for i in range(1, 40)]
    rows += [(1000, " ".join(f"{text} " * 3 for text in words.values()), "en", "a", 0, 1, "k"), (1001, "12 34 -- 56", "en", "a", 0, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, version int, kind string")
    found = {r.doc_id: r for r in language.label(docs, language.train(docs)).collect()}
    assert found[1000].score < 0.5 and {s.lang for s in found[1000].spans} == set(words)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {1001}


def test_a_column_named_like_the_key_stays(spark, tmp_path):
    rows = [(i, f"the cat and the dog went over to that house number {i} with them all", "en", "s", 100 + i) for i in range(12)] + [(None, "der Hund und die Katze gingen", "de", "s", 7), (3, None, "de", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _document int")
    for stage in (corpus_pipeline.duplicates_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        values = {r._document for r in out.collect()}
        assert values <= {r[4] for r in rows} and len(values) > 1
