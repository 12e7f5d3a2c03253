"""Cuckoo filters over 16-byte keys, worked on in bulk with numpy.

A bucket has four slots of 16-bit fingerprints. A key belongs to two buckets, each of which gives the other by its fingerprint, so that a
fingerprint can move without its key. A filter holds a multiset: ``copies`` never says less than were added and not
removed, and says more only where another key has the same fingerprint and buckets. What finds no slot goes to a short list.
"""

from __future__ import annotations

import numpy as np

from palimpsest.llm.tokens import mix

SLOTS, KICKS, LOAD = 4, 64, 0.8


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and fingerprint of keys given as rows of 16 bytes."""
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    mark = (halves[:, 0] >> np.uint64(48)).astype(np.uint16)
    mark[mark == 0] = 1
    return halves[:, 1], mark


def _rank(values: np.ndarray) -> np.ndarray:
    """For sorted values, how many equal ones stand before each."""
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    at = np.arange(len(values))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Cuckoo:
    def __init__(self, buckets: int, data: bytes | None = None, stash: bytes = b""):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), "<u2") if data is None else np.frombuffer(data, "<u2").reshape(buckets, SLOTS).copy()
        self.stash = np.frombuffer(stash, "<u8").reshape(-1, 2).copy()  # (lower bucket, fingerprint)

    @classmethod
    def sized(cls, items: int) -> Cuckoo:
        return cls(1 << max(1, int(np.ceil(np.log2(max(items, 1) / (SLOTS * LOAD))))))

    @property
    def room(self) -> int:
        """How many fingerprints it is made for."""
        return int(self.buckets * SLOTS * LOAD)

    @property
    def items(self) -> int:
        return int((self.slots != 0).sum()) + len(self.stash)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(self.buckets - 1))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, mark = _parts(keys)
        bucket = place & np.uint64(self.buckets - 1)
        return bucket, self._other(bucket, mark), mark

    def copies(self, keys: np.ndarray) -> np.ndarray:
        a, b, mark = self._places(keys)
        found = (self.slots[a] == mark[:, None]).sum(1) + np.where(a == b, 0, (self.slots[b] == mark[:, None]).sum(1))
        for bucket, stashed in self.stash:
            found += (np.minimum(a, b) == bucket) & (mark == stashed)
        return found

    def add(self, keys: np.ndarray) -> None:
        bucket, other, mark = self._places(keys)
        for kick in range(KICKS):
            order = np.argsort(bucket, kind="stable")
            bucket, mark = bucket[order], mark[order]
            empty = self.slots[bucket] == 0
            rank = _rank(bucket)
            fits = rank < empty.sum(1)
            slot = (np.cumsum(empty, 1) == rank[:, None] + 1).argmax(1)
            self.slots[bucket[fits], slot[fits]] = mark[fits]
            bucket, mark = bucket[~fits], mark[~fits]
            if not len(bucket):
                return
            if kick:  # the first of each full bucket takes a slot, and what was there moves on
                first = _rank(bucket) == 0
                at = bucket[first], np.full(first.sum(), kick % SLOTS)
                mark[first], self.slots[at] = self.slots[at], mark[first]
            bucket = self._other(bucket, mark)
        self.stash = np.concatenate([self.stash, np.stack([np.minimum(bucket, self._other(bucket, mark)), mark.astype(np.uint64)], 1)])

    def remove(self, keys: np.ndarray) -> None:
        """Take out one copy for each key; the keys must have been added."""
        a, b, mark = self._places(keys)
        while len(a):
            same = np.lexsort((mark, np.minimum(a, b)))
            a, b, mark = a[same], b[same], mark[same]
            now = _rank(np.minimum(a, b) * np.uint64(1 << 16) + mark) == 0
            bucket = np.where((self.slots[a] == mark[:, None]).any(1), a, b)
            hit = self.slots[bucket] == mark[:, None]
            held = now & hit.any(1)
            self.slots[bucket[held], hit[held].argmax(1)] = 0
            for x, y, m in zip(a[now & ~held], b[now & ~held], mark[now & ~held]):
                gone = np.flatnonzero((self.stash[:, 0] == min(x, y)) & (self.stash[:, 1] == m))[:1]
                self.stash = np.delete(self.stash, gone, axis=0)
            a, b, mark = a[~now], b[~now], mark[~now]
