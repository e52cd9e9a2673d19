"""Cuckoo filter with vectorised insertion, lookup and deletion of 64-bit keys."""

from __future__ import annotations

import numpy as np

from loomgraph.llm.kernel import U64, mix

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; the other bucket of a fingerprint is found from the
    fingerprint and the bucket alone, so keys can be moved and deleted without being known.

    A key that is inserted twice takes two slots, and deletion takes one out.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = U64(len(table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(keys, U64))
        prints = (h >> U64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = h & self.mask
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ mix(prints.astype(U64))) & self.mask

    def _put(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots; True where it was put.  One row a bucket each turn."""
        done = np.zeros(len(prints), bool)
        for _ in range(SLOTS):
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            _, first = np.unique(at[todo], return_index=True)
            rows = todo[first]
            free = self.table[at[rows]] == 0
            ok = free.any(axis=1)
            rows, slot = rows[ok], free[ok].argmax(axis=1)
            self.table[at[rows], slot] = prints[rows]
            done[rows] = True
        return done

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """False if the table is too full; then nothing is certain and a larger one must be built."""
        prints, one, two = self._places(keys)
        left = ~self._put(prints, one)
        prints, at = prints[left], two[left]
        rng = np.random.default_rng(len(self.table))
        for _ in range(rounds):
            left = ~self._put(prints, at)
            prints, at = prints[left], at[left]
            if not len(prints):
                return True
            _, first = np.unique(at, return_index=True)  # one eviction a bucket each turn
            slot = rng.integers(0, SLOTS, len(first))
            out = self.table[at[first], slot].copy()
            self.table[at[first], slot] = prints[first]
            prints = prints.copy()
            prints[first] = out
            at = at.copy()
            at[first] = self._other(at[first], out)
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one slot for each key; only keys that were inserted may be given."""
        prints, one, two = self._places(keys)
        rest = self._take(prints, one)
        self._take(prints[rest], two[rest])

    def _take(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Takes each fingerprint out of its bucket, one row a bucket each turn; the rows that were not there."""
        todo, left = np.arange(len(prints)), [np.zeros(0, np.int64)]
        while len(todo):
            _, first = np.unique(at[todo], return_index=True)
            rows = todo[first]
            same = self.table[at[rows]] == prints[rows, None]
            ok = same.any(axis=1)
            self.table[at[rows[ok]], same[ok].argmax(axis=1)] = 0
            left.append(rows[~ok])
            todo = np.delete(todo, first)
        return np.concatenate(left)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(8, len(keys))
        while True:
            out = cls(size)
            if out.insert(keys):
                return out
            size *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())
