"""A cuckoo filter over 64-bit hashes, with whole arrays inserted, tested and deleted at once."""

from __future__ import annotations

import numpy as np

from labelloom.llm.shingles import mixed_bits

SLOTS = 4
MAX_LOAD = 0.8
_MAX_ROUNDS = 5000


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a fingerprint has two possible buckets.

    A key is found if it was inserted; another key is found with a probability of
    about ``2 * 4 / 2**16``. Only keys that were inserted may be deleted. Keys are
    inserted once each: the caller keeps exact counts.
    """

    def __init__(self, table: np.ndarray, size: int):
        self.table = table
        self.size = size

    @classmethod
    def for_keys(cls, keys: int) -> "CuckooFilter":
        buckets = 1
        while buckets * SLOTS * MAX_LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16), 0)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return cls(table, int(np.count_nonzero(table)))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def has_room(self, more: int) -> bool:
        return self.size + more <= self.table.size * MAX_LOAD

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = mixed_bits(keys)
        prints = (bits >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (bits & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed_bits(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first = self._places(keys)
        second = self._other(first, prints)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Keys not yet inserted. In every round a bucket takes one of those that wait for it."""
        if not self.has_room(len(keys)):
            raise ValueError("the filter is full: build a larger one")
        prints, bucket = self._places(keys)
        # keys may go to either bucket; the emptier one first
        other = self._other(bucket, prints)
        fuller = np.count_nonzero(self.table[bucket], axis=1) > np.count_nonzero(self.table[other], axis=1)
        bucket = np.where(fuller, other, bucket)
        rng = np.random.default_rng(len(self.table))
        for _ in range(_MAX_ROUNDS):
            if not len(bucket):
                self.size = int(np.count_nonzero(self.table))
                return
            _, chosen = np.unique(bucket, return_index=True)
            at, mark = bucket[chosen], prints[chosen]
            free = self.table[at] == 0
            slot = np.where(free.any(axis=1), free.argmax(axis=1), rng.integers(0, SLOTS, len(at)))
            out = self.table[at, slot]
            self.table[at, slot] = mark
            moved = np.flatnonzero(out)
            waiting = np.ones(len(bucket), bool)
            waiting[chosen] = False
            bucket = np.concatenate([bucket[waiting], self._other(at[moved], out[moved])])
            prints = np.concatenate([prints[waiting], out[moved]])
        raise ValueError("no place found: build a larger filter")

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint per key; every key must have been inserted."""
        prints, first = self._places(keys)
        second = self._other(first, prints)
        for mark, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == mark)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    self.size -= 1
                    break
            else:
                raise KeyError("a key that was never inserted")
