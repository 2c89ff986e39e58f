"""A cuckoo filter as one numpy array: membership of 64-bit hashes with insertions and deletions, about 17 bits a key.

A bucket has SLOTS places of a 16-bit fingerprint (0: free). A key may lie in one of two buckets, each known from the other
and the fingerprint alone, so a place can be freed for another key by moving its fingerprint on. An absent key is taken for
a present one with a probability of about 2 * SLOTS / 2^16; a present one is never missed. A key is added once; what it
counts for, and when it goes, is known to the exact table behind the filter.
"""

from __future__ import annotations

import numpy as np

from .words import mix

SLOTS, LOAD, MOVES = 4, 0.85, 500


class Full(Exception):
    """A key found no place within MOVES moves: the caller builds a larger filter."""


class Cuckoo:
    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """Room for so many keys at a load of LOAD; buckets are a power of two."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def raw(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket of each key."""
        h = mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = h & np.uint64(len(self.table) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _settled(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks into free places of their buckets, as many as there are; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        begins = np.r_[True, at[1:] != at[:-1]]
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        free = np.argsort(self.table[at] != 0, axis=1, kind="stable")  # free places first
        fits = rank < (self.table[at] == 0).sum(1)
        self.table[at[fits], free[fits, rank[fits]]] = mark[order][fits]
        found = np.zeros(len(at), bool)
        found[order[fits]] = True
        return found

    def add(self, keys: np.ndarray) -> None:
        """keys: none of them added before (that the exact table says)."""
        if not len(keys):
            return
        mark, one, two = self._places(keys)
        left = np.flatnonzero(~self._settled(mark, one))
        left = left[~self._settled(mark[left], two[left])] if len(left) else left
        turn = 0
        for m, bucket in zip(mark[left].tolist(), one[left].tolist(), strict=True):
            for _ in range(MOVES):
                slot = turn % SLOTS
                turn += 1
                m, self.table[bucket, slot] = int(self.table[bucket, slot]), m
                bucket = int(self._other(np.array([bucket], np.uint64), np.array([m], np.uint16))[0])
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = m
                    break
            else:
                raise Full

    def remove(self, keys: np.ndarray) -> None:
        """keys: all of them added before, and not removed since (that the exact table says)."""
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
            else:
                raise KeyError("a key that was never added")
