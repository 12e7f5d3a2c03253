"""Scoring texts with a bigram model held in Elias-Fano tries.

Tokens are lower-cased words and one end for each text; the end also stands before the first word. Learning texts give counts
c(w) and c(v, w). The base score of a text adds up log10((c + 0.1) / (N + 0.1 (V + 1))). The model: after v, a word w seen there has
probability (1 - b) c(v, w) / c(v), an unseen one b p(w), with p the base. The share b of unseen words belongs to the
class of v (the magnitude of c(v)) and is the share of learning tokens after v's class whose pair was seen only once.

Flow. Texts are dealt to blocks by a hash, once. A block sends its distinct words and pairs, with its learning counts, to
shards: words by their hash, pairs by a hash of the context and one of ``SPLIT`` parts of the successors, so no context, however
common, meets in one place. A shard adds the counts up, builds its trie and answers every block from it. Blocks get
their answers and their texts together (the texts' exchange is used twice) and add up what does not depend on totals
over the corpus: N, V and the shares b come in at the end, as a few numbers. What travels are distinct words and pairs of a
block, packed; a block and a shard have bounded size, and their numbers grow with the corpus.

Trie. Three monotone lists, each in Elias-Fano form (low bits packed, high bits in unary): word or context keys; pointers
from contexts to their first successor; successors as context * 2^32 + code, so each context's successors are a sorted run
relative to it. A search goes to the bucket of the high bits, then through the low bits inside. Values are counts for
words, and for pairs logarithms of probabilities (relative to N) in steps of 2^(1/256), two bytes each. A trie is one
byte string whose parts are used where they lie, in an Arrow buffer or a memory-mapped file.

Defined cases: null and empty texts have the end only; no learning texts: every word is unknown, N is 0 and scores are
those of the base; repeated rows are scored alike and all counted; other columns are not read. Words are told apart by 48
bits of hash and the shard, successors of one context by 32.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import binary, blocks, mix
from palimpsest.workspace import stored

BLOCK_BYTES, SPLIT, STEPS, CLASSES = 8 << 20, 16, 256, 48
END = np.uint64(0x1D8E4E27C47D124F)


# --- tries ----------------------------------------------------------------------------------------------------

class EliasFano:
    """A sorted list of unsigned integers below 2^bits."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray):
        self.n, self.shift, self.packed, self.unary = n, shift, low, high
        self.low = self._unpack()
        ones = np.flatnonzero(np.unpackbits(high)[:_unary_size(n)])
        self.of = ones - np.arange(n)  # high part of each value
        self.first = np.searchsorted(self.of, np.arange(_buckets(n) + 1))

    @staticmethod
    def pack(values: np.ndarray, bits: int) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        shift = max(bits - max(int(n).bit_length(), 1), 0)
        unary = np.zeros(_unary_size(n), np.uint8)
        unary[(values >> np.uint64(shift)).astype(np.int64) + np.arange(n)] = 1
        if shift:
            planes = np.ascontiguousarray(values[:, None].astype(">u8").view(np.uint8).reshape(n, 8))
            low = np.packbits(np.unpackbits(planes, axis=1)[:, 64 - shift:]) if n else np.zeros(0, np.uint8)
        else:
            low = np.zeros(0, np.uint8)
        return [np.array([n, shift, len(low)], "<u8").view(np.uint8), low, np.packbits(unary)]

    @classmethod
    def read(cls, buffer: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, shift, size = (int(x) for x in buffer[at:at + 24].view("<u8"))
        at += 24
        high = -(-_unary_size(n) // 8)
        return cls(n, shift, buffer[at:at + size], buffer[at + size:at + size + high]), _even(at + size + high)

    def _unpack(self) -> np.ndarray:
        if not self.shift or not self.n:
            return np.zeros(self.n, np.uint64)
        bits = np.zeros((self.n, 64), np.uint8)
        bits[:, 64 - self.shift:] = np.unpackbits(self.packed)[:self.n * self.shift].reshape(self.n, self.shift)
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def values(self) -> np.ndarray:
        return (self.of.astype(np.uint64) << np.uint64(self.shift)) | self.low

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, or -1: successor search inside the bucket of its high bits."""
        wanted = wanted.astype(np.uint64)
        top = np.minimum((wanted >> np.uint64(self.shift)), np.uint64(_buckets(self.n))).astype(np.int64)
        inside = top < _buckets(self.n)
        top = np.minimum(top, _buckets(self.n) - 1)
        low, end = self.first[top].copy(), self.first[top + 1]
        rest, high = wanted & np.uint64((1 << self.shift) - 1), end.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            open_ = low < high
            middle = (low + high) // 2
            less = open_ & (self.low[np.minimum(middle, max(self.n - 1, 0))] < rest) if self.n else open_ & False
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        if not self.n:
            return np.full(len(wanted), -1)
        hit = inside & (low < end) & (self.low[np.minimum(low, self.n - 1)] == rest)
        return np.where(hit, low, -1)


def _buckets(n: int) -> int:
    return 1 << max(int(n).bit_length(), 1)


def _unary_size(n: int) -> int:
    return n + _buckets(n)


def _even(at: int) -> int:
    return -(-at // 8) * 8


def quantise(count: np.ndarray) -> np.ndarray:
    """0 for none; else 1 + log2(count) in steps."""
    return np.where(count > 0, 1 + np.rint(STEPS * np.log2(np.maximum(count, 1))), 0).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((code.astype(np.float64) - 1) / STEPS), 0.0)


class Trie:
    """Words with counts, contexts with successors and quantised values, in one byte string."""

    def __init__(self, buffer: np.ndarray):
        self.words, at = EliasFano.read(buffer, 0)
        self.counts = buffer[at:at + 8 * self.words.n].view("<u8")
        self.contexts, at = EliasFano.read(buffer, _even(at + 8 * self.words.n))
        self.pointers, at = EliasFano.read(buffer, at)
        self.successors, at = EliasFano.read(buffer, at)
        self.codes = buffer[at:at + 2 * self.successors.n].view("<u2")

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, codes: np.ndarray, pairs: np.ndarray) -> bytes:
        """words and their counts; contexts, successor codes and counts of pairs, one entry each. All distinct, any order."""
        order = np.argsort(words)
        keys, of = np.unique(contexts, return_inverse=True)
        relative = (of.astype(np.uint64) << np.uint64(32)) | codes.astype(np.uint64)
        by = np.argsort(relative)
        parts: list[np.ndarray] = []
        size = 0

        def put(*arrays: np.ndarray) -> None:
            nonlocal size
            for a in arrays:
                parts.append(a.view(np.uint8))
                size += a.nbytes
            parts.append(np.zeros(_even(size) - size, np.uint8))
            size = _even(size)
        put(*EliasFano.pack(words[order], 64))
        put(counts[order].astype("<u8"))
        put(*EliasFano.pack(keys, 64))
        starts = np.searchsorted(of[by], np.arange(len(keys) + 1))
        put(*EliasFano.pack(starts, max(int(len(by)).bit_length(), 1) + 1))
        put(*EliasFano.pack(relative[by], 32 + max(int(len(keys)).bit_length(), 1)))
        put(quantise(pairs[by]))
        return b"".join(p.tobytes() for p in parts)

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        at = self.words.find(words)
        return np.where(at >= 0, self.counts[at], 0) if self.words.n else np.zeros(len(words), np.uint64)

    def pair_codes(self, contexts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at = self.contexts.find(contexts)
        found = self.successors.find((np.maximum(at, 0).astype(np.uint64) << np.uint64(32)) | codes.astype(np.uint64))
        ok = (at >= 0) & (found >= 0)
        return np.where(ok, self.codes[np.maximum(found, 0)], 0).astype("<u2") if self.successors.n else np.zeros(len(contexts), "<u2")

    def fan(self) -> np.ndarray:
        """Number of successors of each context."""
        return np.diff(self.pointers.values().astype(np.int64))


# --- blocks ---------------------------------------------------------------------------------------------------

class Tokens:
    """Tokens of a block: distinct words and pairs in order of (shard, key), and where each token is among them."""

    def __init__(self, table: pa.Table, shards: int):
        hashes, texts, lengths, done = [], [], [], 0
        for _, block in blocks(iter(table.select(["text"]).combine_chunks().to_batches())):
            _, _, h, first = block.words()
            n = np.diff(first)
            hashes.append(np.insert(h, first[1:], END))
            lengths.append(n + 1)
            texts.append(np.repeat(np.arange(done, done + block.rows), n + 1))
            done += block.rows
        self.rows = done
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        before = np.empty_like(h)
        before[1:] = h[:-1]  # behind an end comes the next text, whose first context is the end
        before[:1] = END
        self.words, self.word_shard, self.word = _distinct(h, shards)
        code = (mix(h) >> np.uint64(32)).astype(np.uint32)
        part = mix(before + (code % np.uint32(SPLIT)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        key = mix(part + code.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        at, _ = pd.factorize(key)
        some = np.zeros(at.max(initial=-1) + 1, np.int64)
        some[at] = np.arange(len(at))
        contexts, codes = part[some], code[some]
        shard = (contexts % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((codes, contexts, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.contexts, self.codes, self.pair_shard, self.pair = contexts[order], codes[order], shard[order], place[at]
        self.before = self.word[np.maximum(np.arange(len(h)) - 1, 0)]
        if len(h):
            ends = np.flatnonzero(h == END)
            self.before[0] = self.word[ends[0]]


def _distinct(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(values)
    distinct = np.asarray(distinct, np.uint64)
    shard = (mix(distinct) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((distinct, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], shard[order], place[codes] if len(codes) else codes


def _keys(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Keys without their low 16 bits: with the shard, which the low bits choose, enough to tell them apart."""
    return binary(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:].copy().view("V6").ravel(), cuts)


def _read_keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw, cuts = _join(column, np.uint8)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64), cuts // 6


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


_ASK = "shard long, block long, words binary, word_counts binary, contexts binary, fan binary, codes binary, pair_counts binary"


def _ask(shards: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        t = Tokens(table, shards)
        learnt = ~np.asarray(table["held_out"].combine_chunks())
        weight = learnt[t.text].astype(np.float64) if t.rows else np.zeros(0)
        word_counts = np.bincount(t.word, weights=weight, minlength=len(t.words)).astype("<u4")
        pair_counts = np.bincount(t.pair, weights=weight, minlength=len(t.codes)).astype("<u4")
        w = np.searchsorted(t.word_shard, np.arange(shards + 1))
        p = np.searchsorted(t.pair_shard, np.arange(shards + 1))
        head = np.ones(len(t.codes), bool)
        head[1:] = t.contexts[1:] != t.contexts[:-1]
        heads = np.flatnonzero(head)
        c = np.searchsorted(heads, p)
        fan = np.diff(np.append(heads, len(t.codes))).astype("<u4")
        return pa.table([pa.array(np.arange(shards), pa.int64()), pa.array(np.full(shards, key[0].as_py()), pa.int64()), _keys(t.words, w), binary(word_counts, w),
                         _keys(t.contexts[heads], c), binary(fan, c), binary(t.codes.astype("<u4"), p), binary(pair_counts, p)],
                        names=[x.split()[0] for x in _ASK.split(", ")])
    return ask


_ANSWER = "block long, shard long, word_counts binary, pair_codes binary, vocabulary long, trie_bytes long"


def _join(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    words, w = _read_keys(table["words"])
    n, _ = _join(table["word_counts"], "<u4")
    contexts, _ = _read_keys(table["contexts"])
    fan, _ = _join(table["fan"], "<u4")
    codes, p = _join(table["codes"], "<u4")
    m, _ = _join(table["pair_counts"], "<u4")
    contexts = np.repeat(contexts, fan)
    at, distinct = pd.factorize(words)
    total = np.bincount(at, weights=n, minlength=len(distinct))
    known = total > 0
    pair_at, pair_keys = pd.factorize(mix(contexts + codes.astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
    some = np.zeros(len(pair_keys), np.int64)
    some[pair_at] = np.arange(len(pair_at))
    pair_total = np.bincount(pair_at, weights=m, minlength=len(pair_keys))
    seen = pair_total > 0
    raw = Trie.build(np.asarray(distinct, np.uint64)[known], total[known], contexts[some][seen], codes[some][seen], pair_total[seen])
    trie = Trie(np.frombuffer(raw, np.uint8))
    rows = table.num_rows
    number = np.zeros(rows, np.int64)
    number[0] = int(known.sum())
    size = np.zeros(rows, np.int64)
    size[0] = len(raw)
    return pa.table([table["block"].combine_chunks(), table["shard"].combine_chunks(), binary(trie.word_counts(words).astype("<u8"), w), binary(trie.pair_codes(contexts, codes), p), pa.array(number), pa.array(size)],
                    names=[x.split()[0] for x in _ANSWER.split(", ")])


def _score(kind: str, shards: int):
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_part double, score_part double, seen array<int>, unseen array<int>, once array<int>, vocabulary long"

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(texts, shards)
        answers = answers.sort_by("shard")
        counts, _ = _join(answers["word_counts"], "<u8")
        codes, _ = _join(answers["pair_codes"], "<u2")
        c = counts.astype(np.float64)[t.word]
        after = counts.astype(np.float64)[t.before]
        code = codes[t.pair]
        there = (code > 0) & (after > 0)
        base = np.log10(c + 0.1)
        part = np.where(there, np.log10(np.maximum(restore(code), 1)) - np.log10(np.maximum(after, 1)), base)
        classes = np.minimum(np.log2(np.maximum(after, 1)).astype(np.int64), CLASSES - 1)
        learnt = ~np.asarray(texts["held_out"].combine_chunks())
        n = t.rows

        def per(mask: np.ndarray) -> pa.Array:
            cells = np.bincount(t.text[mask] * CLASSES + classes[mask], minlength=n * CLASSES).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CLASSES), pa.array(cells))
        total = lambda x: np.bincount(t.text, weights=x, minlength=n)
        vocabulary = np.zeros(n, np.int64)
        vocabulary[:1] = sum(answers["vocabulary"].to_pylist())
        return pa.table([texts["doc_id"].combine_chunks(), texts["held_out"].combine_chunks(), pa.array(t.length, pa.int64()), pa.array(total(c > 0).astype(np.int64)),
                         pa.array(total(base)), pa.array(total(part)), per(there), per(~there), per((code == 1) & learnt[t.text]), pa.array(vocabulary)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_part", "score_part", "seen", "unseen", "once", "vocabulary"])
    return score, schema


def score_report(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(-(-size // block_bytes), spark.sparkContext.defaultParallelism)
    shards = max(count // 2, 1)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("bigint")
    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), block.alias("block")).repartition("block")
    asked = texts.groupBy("block").applyInArrow(_ask(shards), _ASK)
    answers = asked.groupBy("shard").applyInArrow(_answer, _ANSWER)
    score, schema = _score(docs.schema["doc_id"].dataType.simpleString(), shards)
    parts = stored(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema), "lm-scores")
    return _finished(parts)


def _finished(parts: DataFrame) -> DataFrame:
    """Put the totals of the corpus in: N, V and the share of unseen words by class."""
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("once", "seen", "unseen") for k in range(CLASSES)]
    learnt = parts.filter("not held_out").agg(F.sum("n_tokens").alias("n"), *sums).first()
    vocabulary = parts.agg(F.sum("vocabulary")).first()[0] or 0
    n = learnt.n or 0
    scale = float(np.log10(n + 0.1 * (vocabulary + 1)))
    shares = []
    for k in range(CLASSES):
        tokens = (learnt[f"seen{k}"] or 0) + (learnt[f"unseen{k}"] or 0)
        shares.append(min(max((learnt[f"once{k}"] or 0) / tokens, 1e-3), 1 - 1e-3) if tokens else 0.5)
    weigh = lambda column, factors: F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, factors)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    if n:
        extra = weigh("seen", [float(np.log10(1 - b)) for b in shares]) + weigh("unseen", [float(np.log10(b)) - scale for b in shares])
    else:  # nothing learnt: the base alone
        extra = weigh("unseen", [-scale] * CLASSES)
    return parts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
                        (F.col("base_part") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("score_part") + extra).alias("score"))
