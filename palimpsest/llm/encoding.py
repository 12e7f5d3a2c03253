"""Subword ids of whole texts: every distinct piece is encoded once by the tokenizers library.

The tokenizer drops white space, lower-cases, and ends pieces where an ASCII letter meets an ASCII digit or mark.
So a text's ids are those of its pieces in order, and equal pieces have equal ids. Cuts are made only where the
tokenizer itself always cuts: at ASCII white space, and between ASCII letters, digits and marks; never beside an
apostrophe (contractions) or a byte above 127 (its class is not known). Texts that hold ``<|`` (special tokens)
are encoded whole. ``tests/llm`` compares ids with those of whole texts.
"""

from __future__ import annotations

import hashlib
import sys
import types
from pathlib import Path

import numpy as np
import pyarrow as pa

from palimpsest.llm import tokens
from palimpsest.llm.tokens import BYTES, Block, factorize

#: Pieces a worker remembers at most; then it starts anew. Bounds memory (about 25 bytes each), not results.
REMEMBERED = 500_000

# classes: 0 white space, 1 letter, 2 digit, 3 mark, 4 no cut inside or beside
_CLASS = np.full(256, 4, np.uint8)
_CLASS[tokens.BLANK_BYTES] = 0
_CLASS[((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122))] = 1
_CLASS[(BYTES >= 48) & (BYTES <= 57)] = 2
_CLASS[((BYTES >= 33) & (BYTES <= 47) | (BYTES >= 58) & (BYTES <= 64) | (BYTES >= 91) & (BYTES <= 96) | (BYTES >= 123) & (BYTES <= 126)) & (BYTES != 39)] = 3


def _of_worker(name: str, make):
    """A value that stays in the worker process from task to task."""
    keep = sys.modules.setdefault("_palimpsest_worker", types.ModuleType("_palimpsest_worker"))
    if not hasattr(keep, name):
        setattr(keep, name, make())
    return getattr(keep, name)


class _Known:
    """Ids of pieces by hash: sorted hashes, and where their ids lie."""

    def __init__(self):
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.hash, h)
        i[i == len(self.hash)] = 0
        return i, (self.hash[i] == h if len(self.hash) else np.zeros(len(h), bool))

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.ids.dtype)])
        self.ids[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        order = np.argsort(h)
        to = np.searchsorted(self.hash, h[order])
        self.hash, self.at, self.n = (np.insert(a, to, b[order]) for a, b in ((self.hash, h), (self.at, at), (self.n, n.astype(np.int32))))


class Encoder:
    """Built from a tokenizer's JSON, which travels with the job."""

    def __init__(self, path: str):
        self.json = Path(path).read_text(encoding="utf-8")
        self.name = hashlib.sha256(self.json.encode()).hexdigest()

    def _library(self):
        def make():
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(self.json)
            return t, t.token_to_id("<|endoftext|>")
        return _of_worker(f"tokenizer{self.name}", make)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, end to end, and their numbers: many texts a call, parted by a special token."""
        library, stop = self._library()
        out = []
        for i in range(0, len(texts), 1000):
            out.append(np.array(library.encode_batch_fast(["<|endoftext|>".join(texts[i:i + 1000])], add_special_tokens=False)[0].ids + [stop], np.int64))
        ids = np.concatenate(out) if out else np.zeros(0, np.int64)
        stops = np.flatnonzero(ids == stop)
        return ids[ids != stop], np.diff(stops, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text). Null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = np.array(pa.compute.match_substring(texts, "<|").to_numpy(zero_copy_only=False), bool)
        plain = pa.compute.if_else(pa.array(~special), texts, "") if special.any() else texts
        ids, counts = self._plain(Block(plain))
        if not special.any():
            return ids, counts
        library, _ = self._library()
        whole = [np.array(library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(special)).to_pylist()]
        at = np.cumsum(counts) - counts
        out = np.insert(ids, np.repeat(at[special], [len(w) for w in whole]), np.concatenate(whole))
        counts[special] = [len(w) for w in whole]
        return out, counts

    def _plain(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        known = _of_worker(f"known{self.name}", _Known)
        if len(known.hash) > REMEMBERED:
            known.__init__()
        kind = _CLASS[block.data]
        starts, ends = block.spans(tokens.NOT_BLANK)
        inner = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0) & (kind[1:] != 4) & (kind[:-1] != 4)) + 1
        inner = np.setdiff1d(inner, block.bounds, assume_unique=True)  # texts are parted already
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        h = block.word_hashes(starts, ends, tokens.LOWER[block.data])
        codes, distinct = factorize(h)
        where, found = known.find(distinct)
        if not found.all():
            new = np.flatnonzero(~found)
            some = np.zeros(len(distinct), np.int64)
            some[codes] = np.arange(len(codes))
            raw = block.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist())]
            ids, n = self._pieces(texts)
            known.add(distinct[new], ids.astype(np.uint32), n)
            where, _ = known.find(distinct)
        n = known.n[where][codes].astype(np.int64)
        first = known.at[where][codes]
        done = np.cumsum(n)
        total = int(done[-1]) if len(done) else 0
        ids = known.ids[np.arange(total) + np.repeat(first - (done - n), n)] if total else np.zeros(0, known.ids.dtype)
        before = np.concatenate([[0], done])[np.searchsorted(starts, block.bounds)]
        return ids, np.diff(before)
