"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are leftmost, non-overlapping matches of one pattern for each kind, with a check of each match; a match
that fails is dropped. They lose data that runs together (a phone number before a card number is one match of too many
digits). The field finds those: it looks at regions, runs of digits with few marks between or the surroundings of an
``@``, cuts them into digit runs, words and marks, and scores whole candidate segments by type with features of the whole
span: its shape, number of digits, checksum, range of its parts, neighbours. A dynamic programme over segments of at
most ``MOST_TOKENS`` tokens chooses boundaries and types together. Its spans are added where no base span overlaps.

Weights are learnt by gradient steps on the conditional likelihood (forward-backward over segments), from regions of
about ``SAMPLE_DOCS`` documents chosen by a hash of the id, labelled by the base rules; regions in which a base match
failed although it may hold several items are left out. Equal regions (same shape, checks and neighbours) are counted
first, so the driver gets distinct regions only. Everything starts at a prior against adding spans.

Defined cases: null and empty texts have no spans; overlapping base spans of different kinds all stay; positions are
code points with exclusive ends; texts are read whole; a region of any length costs time in proportion to it; repeated
rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import BYTES, Block, blocks

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SAMPLE_DOCS, MOST_TOKENS, EPOCHS, PRIOR = 20_000, 14, 12, -3.0
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_RUN = re.compile(r"[+(]?[0-9](?:[ ().+\-]{0,3}[0-9])*")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]*+@[A-Za-z0-9._%+\-@]*")
# Two patterns start with a run of one class, and only its first character, or what a match leaves of it, can start a match. So
# each run is read once, however long.
_LEAD = {"email": "[A-Za-z0-9._%+-]", "ip": "[0-9]"}
_WHOLE = {k: re.compile(f"{lead}+{PATTERNS[k][len(lead):]}") for k, lead in _LEAD.items()}
_AHEAD = {k: re.compile(f"(?<!{lead}){lead}+{PATTERNS[k][len(lead):]}") for k, lead in _LEAD.items()}
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_DIGIT = (BYTES >= 48) & (BYTES <= 57)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _found(kind: str, text: str) -> Iterator[re.Match]:
    """Leftmost matches that don't overlap, as finditer gives them."""
    if kind not in _LEAD:
        yield from _COMPILED[kind].finditer(text)
        return
    m = _AHEAD[kind].search(text)
    while m:
        yield m
        m = _WHOLE[kind].match(text, m.end()) or _AHEAD[kind].search(text, m.end())


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(valid, failed) matches by kind, then start."""
    good: list[Span] = []
    failed: list[Span] = []
    for kind in KINDS:
        if (kind == "email" and "@" not in text) or (kind == "phone" and "+" not in text):
            continue
        for m in _found(kind, text):
            (good if _valid(kind, m.group()) else failed).append((kind, m.start(), m.end()))
    return good, failed


# --- regions and candidate segments ---------------------------------------------------------------------------

def regions(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of runs with seven digits or more, and of surroundings of ``@``."""
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 7 and sum(c.isdigit() for c in m.group()) >= 7:
            yield m.start(), m.group()
    if "@" in text:
        for m in _MAIL.finditer(text):
            yield m.start(), m.group()


def _shape(token: str) -> str:
    return f"d{min(len(token), 20)}" if token[0].isdigit() else "a" if token.isalpha() else token


def _beside(c: str) -> str:
    return "none" if not c else "blank" if c.isspace() else "word" if c.isalnum() else "mark"


def candidates(shapes: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(first token, end, type) that a segment may have by its tokens alone."""
    out = []
    for i, first in enumerate(shapes):
        if first[0] not in "da+(":
            continue
        digits = 0
        for j in range(i + 1, min(i + MOST_TOKENS, len(shapes)) + 1):
            last = shapes[j - 1]
            digits += int(last[1:]) if last[0] == "d" else 0
            if last[0] not in "da":
                continue
            marks = {s for s in shapes[i:j] if s[0] not in "da"}
            if "@" in marks:
                at = shapes.index("@", i)
                if first[0] not in "+(" and "@" not in shapes[at + 1:j] and "." in shapes[at + 1:j]:
                    out.append((i, j, "email"))
            elif "a" not in shapes[i:j]:
                if j - i == 7 and shapes[i + 1] == shapes[i + 3] == shapes[i + 5] == ".":
                    out.append((i, j, "ip"))
                if 13 <= digits <= 19 and marks <= {" ", "-"}:
                    out.append((i, j, "card"))
                if 7 <= digits <= 15:
                    out.append((i, j, "phone"))
    return out


class Region:
    """Tokens of a region; ``key`` is equal for regions that the field cannot tell apart."""

    def __init__(self, found: str, before: str, after: str):
        self.tokens = _TOKEN.findall(found)
        self.cuts = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).tolist()
        self.shapes = tuple(map(_shape, self.tokens))
        self.segments = candidates(self.shapes)
        checks = tuple(self._check(found, *s) for s in self.segments)
        self.key = (self.shapes, _beside(before), _beside(after), checks)

    def _check(self, found: str, i: int, j: int, kind: str) -> int:
        return int(kind in ("ip", "card") and _valid(kind, found[self.cuts[i]:self.cuts[j]]))


Key = tuple[tuple[str, ...], str, str, tuple[int, ...]]


def segment_features(key: Key) -> list[tuple[int, int, str, list[tuple]]]:
    """Every candidate of a region with its whole-span features."""
    shapes, before, after, checks = key
    out = []
    for (i, j, kind), check in zip(candidates(shapes), checks):
        part = shapes[i:j]
        digits = sum(int(s[1:]) for s in part if s[0] == "d")
        left = before if i == 0 else _beside(shapes[i - 1] if shapes[i - 1][0] not in "da" else "0")
        right = after if j == len(shapes) else _beside(shapes[j] if shapes[j][0] not in "da" else "0")
        shape = "@" if kind == "email" else "".join("d" if kind == "ip" and s[0] == "d" else s for s in part)
        out.append((i, j, kind, [(kind, "shape", shape), (kind, "digits", digits if kind != "ip" and kind != "email" else 0), (kind, "check", check),
                                 (kind, "left", left), (kind, "right", right), (kind, "first", part[0][0]), (kind, "tokens", min(j - i, 8))]))
    return out


class Field:
    """Weights of segment features; a token outside of segments scores nothing, a segment starts at PRIOR."""

    def __init__(self, weights: dict[tuple, float] | None = None):
        self.weights = dict(weights or {})

    def _scored(self, key: Key):
        return [(i, j, kind, f, PRIOR + sum(self.weights.get(x, 0.0) for x in f)) for i, j, kind, f in segment_features(key)]

    def decode(self, key: Key) -> list[tuple[int, int, str]]:
        """Best segmentation; ties prefer no segment."""
        n = len(key[0])
        ends = defaultdict(list)
        for i, j, kind, _, s in self._scored(key):
            ends[j].append((i, kind, s))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, s in ends[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def train(self, examples: list[tuple[Key, tuple, int]], epochs: int = EPOCHS, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """examples: (region, its segments, how often). Adaptive gradient steps on the log-likelihood."""
        seen: dict[tuple, float] = defaultdict(lambda: 1e-2)
        for _ in range(epochs):
            for key, gold, count in examples:
                scored, n = self._scored(key), len(key[0])
                ends, starts = defaultdict(list), defaultdict(list)
                for i, j, kind, f, s in scored:
                    ends[j].append((i, s))
                    starts[i].append((j, s))
                ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, s in ends[j])])
                for i in range(n - 1, -1, -1):
                    behind[i] = _log_sum([behind[i + 1], *(behind[j] + s for j, s in starts[i])])
                step: dict[tuple, float] = defaultdict(float)
                for i, j, kind, f, s in scored:
                    miss = ((i, j, kind) in gold) - math.exp(ahead[i] + s + behind[j] - ahead[n])
                    for x in f:
                        step[x] += miss
                for x, g in step.items():
                    g = g * math.log1p(count) - ridge * self.weights.get(x, 0.0)
                    seen[x] += g * g
                    self.weights[x] = self.weights.get(x, 0.0) + rate * g / math.sqrt(seen[x])


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def _regions_of(text: str) -> Iterator[tuple[int, Region]]:
    for start, found in regions(text):
        end = start + len(found)
        yield start, Region(found, text[start - 1:start], text[end:end + 1])


def examples_of(text: str) -> Iterator[tuple[Key, tuple]]:
    """Regions with the segments that the base rules give; unclear ones are left out."""
    good, failed = base_spans(text)
    for start, region in _regions_of(text):
        end = start + region.cuts[-1]
        digits = sum(int(s[1:]) for s in region.shapes if s[0] == "d")
        if any(a < end and z > start for _, a, z in failed) and digits > 16:
            continue
        at = {c + start: k for k, c in enumerate(region.cuts)}
        gold = tuple(sorted((at.get(a, -1), at.get(z, -1), kind) for kind, a, z in good if a < end and z > start))
        if set(gold) <= set(region.segments) and all(x[1] <= y[0] for x, y in zip(gold, gold[1:])):
            yield region.key, gold


def added_spans(text: str, good: list[Span], field: Field, known: dict[Key, list]) -> list[Span]:
    out = []
    for start, region in _regions_of(text):
        if not region.segments:
            continue
        if region.key not in known:
            if len(known) > 100_000:  # bounds memory; decoding again gives the same
                known.clear()
            known[region.key] = field.decode(region.key)
        for i, j, kind in known[region.key]:
            a, z = start + region.cuts[i], start + region.cuts[j]
            if not any(a < y and z > x for _, x, y in good + out):
                out.append((kind, a, z))
    return out


# --- tables ---------------------------------------------------------------------------------------------------

def _live(block: Block) -> np.ndarray:
    """Rows with a digit or an ``@``; the others have no spans of any kind."""
    hit = np.concatenate([[0], np.cumsum(_DIGIT[block.data] | (block.data == 64))])
    return np.flatnonzero(np.diff(hit[block.bounds]))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit the field on about ``sample_docs`` documents of (doc_id, text)."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for rows, block in blocks(batches):
            for i in _live(block):
                found.update(repr(x) for x in examples_of(rows.column(0)[int(i)].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["example", "n"])

    from ast import literal_eval

    total = max(docs.count(), 1)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1e6 * sample_docs / total))
    counted = chosen.select("text").mapInArrow(gather, "example string, n long").groupBy("example").agg(F.sum("n").alias("n"))
    examples = [(*literal_eval(r.example), r.n) for r in sorted(counted.collect())]  # distinct regions of the sample
    field = Field()
    field.train(examples)
    return field


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and added (lists of kind, start, end) for every row of (doc_id, text)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[Key, list] = {}
        for rows, block in blocks(batches):
            base: list[list] = [[] for _ in range(block.rows)]
            added: list[list] = [[] for _ in range(block.rows)]
            for i in _live(block):
                text = rows.column(1)[int(i)].as_py()
                good, _ = base_spans(text)
                base[i] = [dict(zip(("kind", "start", "end"), s)) for s in good]
                added[i] = [dict(zip(("kind", "start", "end"), s)) for s in added_spans(text, good, field, known)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(base, span), pa.array(added, span)], ["doc_id", "base", "added"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {each}, added {each}")


def _listed(spans):
    """``kind:start:end`` by kind, then start, joined by commas."""
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(place, s.kind).alias("k"), s.start.alias("a"), s.end.alias("z"), s.kind.alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s.kind, s.a.cast("string"), s.z.cast("string"))), ",")


def _count_of(kind: str):
    return F.size(F.filter("base", lambda s: s.kind == kind))


def private_report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added), n_added."""
    found = find(docs, train(docs))
    counts = [_count_of(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
