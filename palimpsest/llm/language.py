"""Language of whole texts and of their spans: script ranges, per-word scores, and Viterbi with a switching penalty.

A word is a run of ASCII letters and bytes above 127. Its script is the highest of the script ranges of its
characters, and only languages that write ``SCRIPT_SHARE`` of their training words in that script are candidates. A
candidate's score is the log probability of the word's byte trigrams (with the blanks around it) and of the word
itself, both hashed to ``BUCKETS`` buckets; a word can speak against a language with at most ``CLIP``. Viterbi over all
words, paying ``PENALTY`` for each change of language, labels spans of mixed text.

Most texts need no step-by-step search: if no run of words prefers other languages to the best single one by more than
one penalty, the constant path is the optimum. That test is a running minimum over whole blocks. The rest go through
Viterbi together, one step for all of them at a time.

Training reads at most about ``TRAIN_DOCS`` documents of each language (chosen by a hash of the id), the model has
2 * BUCKETS numbers a language whatever the corpus, and travels to the tasks with the job.

Defined cases: ``und`` with score 0 if a text is null or has no letter; equal scores go to the first language by code
point; texts of any length are read whole; an untrained model (no labelled rows) says ``und``; repeated rows get equal
labels; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import BYTES, LOWER, Block, blocks

BUCKETS = 1 << 16
TRAIN_DOCS = 3000
PENALTY, CLIP, SCRIPT_SHARE = 12.0, 8.0, 0.001
UNKNOWN = "und"

_LETTER = ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES > 127)
# First code point of each script range of Unicode, and the script's number; 1 is Latin, 0 other.
_RANGES = [(0x00, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5),
           (0x600, 6), (0x700, 0), (0x750, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xE00, 9), (0xE80, 0), (0x10A0, 10),
           (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13),
           (0x4DC0, 0), (0x4E00, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0)]
_FIRST, _SCRIPT = np.array([r[0] for r in _RANGES]), np.array([r[1] for r in _RANGES], np.uint8)
SCRIPTS = 14


@dataclass
class Model:
    """Log probabilities of trigram and word buckets, and allowed scripts, by language in order of code points."""

    langs: list[str]
    trigram: np.ndarray
    word: np.ndarray
    allowed: np.ndarray


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    trigram: np.ndarray
    word: np.ndarray
    script: np.ndarray


def words_of(block: Block) -> Words:
    """Spans, trigram buckets by byte (a word has those from the byte before it), word buckets and scripts."""
    starts, ends = block.spans(_LETTER)
    clean = np.full(len(block.data) + 3, 32, np.uint8)  # one blank in front
    clean[1:-2] = np.where(_LETTER[block.data], LOWER[block.data], 32)
    clean32 = clean.astype(np.uint32)
    key = clean32[:-2] | clean32[1:-1] << np.uint32(8) | clean32[2:] << np.uint32(16)
    trigram = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
    h = block.word_hashes(starts, ends, LOWER[block.data])
    script = np.ones(len(starts), np.uint8)
    lead = np.flatnonzero(block.data >= 0xC2)
    if len(lead):
        b = np.concatenate([block.data, np.zeros(3, np.uint8)]).astype(np.int64)
        c0, c1, c2 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63
        point = np.where(c0 < 0xE0, (c0 & 31) << 6 | c1, np.where(c0 < 0xF0, (c0 & 15) << 12 | c1 << 6 | c2, 0x10000))
        of = np.searchsorted(starts, lead, side="right") - 1
        kinds = np.where(point > 0xFFFF, 0, _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1])
        np.maximum.at(script, of, kinds.astype(np.uint8))
    return Words(starts, ends, np.searchsorted(starts, block.bounds), trigram, (h >> np.uint64(48)).astype(np.int64), script)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from (doc_id, text, lang): rows with a language that are not held out, about ``train_docs`` a language."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # one number for each language; as a constant it filters the scan, and no text moves that is not learnt from
    share = {r.lang: train_docs * 1e6 / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(s)) for lang, s in share.items()], F.lit(0.0))
    chosen = (rows.select("doc_id", "text", "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < wanted)
              .select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(8))).alias("part")))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        got = np.zeros(2 * BUCKETS + SCRIPTS, np.int64)
        for batch in table.to_batches():
            for _, block in blocks(iter([batch])):
                w = words_of(block)
                n = w.ends - w.starts + 1  # trigrams of a word: from the blank before it
                at = np.repeat(w.starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                got[:BUCKETS] += np.bincount(w.trigram[at], minlength=BUCKETS)
                got[BUCKETS:2 * BUCKETS] += np.bincount(w.word, minlength=BUCKETS)
                got[2 * BUCKETS:] += np.bincount(w.script, minlength=SCRIPTS)
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([got.astype("<i4").tobytes()], pa.binary())})

    # eight rows of fixed size for each language
    sums: dict[str, np.ndarray] = {}
    for row in chosen.groupBy("lang", "part").applyInArrow(count, "lang string, counts binary").collect():
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(row.counts, "<i4").astype(np.float64)
    langs = sorted(sums, key=lambda x: x.encode())
    table = np.array([sums[x] for x in langs]).reshape(len(langs), 2 * BUCKETS + SCRIPTS)
    logs = lambda c: np.log((c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    scripts = table[:, 2 * BUCKETS:]
    return Model(langs, logs(table[:, :BUCKETS]), logs(table[:, BUCKETS:2 * BUCKETS]), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1))


def scores(w: Words, model: Model) -> np.ndarray:
    """Words by languages, at most 0 (the best candidate) and at least -CLIP."""
    s = np.empty((len(w.starts), len(model.langs)))
    for k in range(len(model.langs)):
        sums = np.zeros(len(w.trigram) + 1)
        np.cumsum(model.trigram[k][w.trigram], out=sums[1:])
        s[:, k] = 0.5 * (sums[w.ends + 1] - sums[w.starts]) + model.word[k][w.word]
    allowed = model.allowed[:, w.script].T
    s[~allowed & allowed.any(axis=1, keepdims=True)] = -np.inf
    s -= s.max(axis=1, keepdims=True)
    return np.maximum(s, -CLIP)


def viterbi(s: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word; text i has words first[i] to first[i + 1]. Ties keep the language, then take the first."""
    label = np.zeros(len(s), np.int32)
    n = np.diff(first)
    rows = np.flatnonzero(n)
    if not len(rows):
        return label
    total = np.add.reduceat(s, first[:-1][rows], axis=0)
    best = total.argmax(axis=1)
    label[:] = np.repeat(best, n[rows]).astype(np.int32)
    if s.shape[1] == 1:
        return label
    own = np.take_along_axis(s, label[:, None].astype(np.int64), 1)[:, 0]
    other = s.copy()
    np.put_along_axis(other, label[:, None].astype(np.int64), -np.inf, 1)
    gain = np.concatenate([[0.0], np.cumsum(other.max(axis=1) - own)])
    ends = first[1:][rows]
    # largest gain of a run inside each text: running minimum, lowered from text to text so that it starts anew
    text = np.repeat(np.arange(len(rows)), n[rows])
    fall = (CLIP + 1) * (first[:-1][rows] + np.arange(len(rows)))[text] * 2
    low = np.minimum.accumulate(gain[:-1] - fall)
    run = np.maximum.reduceat(gain[1:] - fall - low, first[:-1][rows])
    hard = rows[run > penalty]
    if not len(hard):
        return label
    hard = hard[np.argsort(-n[hard], kind="stable")]
    at, length = first[:-1][hard], n[hard]
    k = s.shape[1]
    v = s[at].copy()
    back = [None]
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, side="left"))
        top = v[:live].argmax(axis=1)
        jump = v[np.arange(live), top] - penalty
        stay = v[:live] >= jump[:, None]
        v[:live] = np.where(stay, v[:live], jump[:, None]) + s[at[:live] + t]
        back.append(np.where(stay, np.arange(k), top[:, None]).astype(np.int32 if k > 127 else np.int8))
    now = v.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        label[at[:live] + t] = now[:live]
        if t:
            now[:live] = back[t][np.arange(live), now[:live]]
    return label


def _lettered(rows: pa.Array, block: Block) -> np.ndarray:
    """Does the text hold a letter? Bytes decide it for ASCII; the rest is looked up character by character."""
    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[block.data] & (block.data < 128))])[block.bounds]
    high = np.concatenate([[0], np.cumsum(block.data > 127)])[block.bounds]
    found = np.diff(ascii_letter) > 0
    for i in np.flatnonzero(~found & (np.diff(high) > 0)):
        found[i] = any(c.isalpha() for c in rows[int(i)].as_py())
    return found


def label(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (share of word bytes in that language), spans (start, end in code points; lang)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    names = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches):
            w = words_of(block)
            n, size = block.rows, (w.ends - w.starts)
            text = np.repeat(np.arange(n), np.diff(w.first))
            k = max(len(model.langs), 1)
            path = viterbi(scores(w, model), w.first, penalty) if model.langs else np.zeros(len(w.starts), np.int32)
            weight = np.bincount(text * k + path, weights=size, minlength=n * k).reshape(n, k)
            best = weight.argmax(axis=1)
            known = _lettered(rows.column(1), block) & (len(model.langs) > 0)
            score = np.where(known, weight[np.arange(n), best] / np.maximum(weight.sum(axis=1), 1), 0.0)
            pred = names[np.where(known, best, len(model.langs))]
            # runs of one label inside one text
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (path[1:] != path[:-1])
            heads = np.flatnonzero(new & known[text]) if len(text) else np.zeros(0, np.int64)
            heads_all = np.flatnonzero(new)
            tails = np.append(heads_all[1:], len(text))[np.searchsorted(heads_all, heads)] - 1
            points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            base = points[block.bounds[text[heads]]]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(text[heads], minlength=n))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array(points[w.starts[heads]] - base, pa.int64()), pa.array(points[w.ends[tails]] - base, pa.int64()), pa.array(names[path[heads]], pa.string())], fields=list(span)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model learnt from those that are not held out."""
    return label(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def accuracy(docs: DataFrame, report: DataFrame) -> float:
    """Share of held-out documents with a language whose prediction is right."""
    truth = docs.filter(F.col("lang").isNotNull()).select(F.col("doc_id").alias("of"), "lang")
    row = report.filter("held_out").join(truth, F.col("doc_id") == F.col("of")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    return row.a
