"""Sorted arrays of hashes with a directory on the leading bits: vectorised exact look-up."""

from __future__ import annotations

import numpy as np

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class HashArray:
    """Ascending 64-bit hashes; they are spread evenly, so a bucket of the directory holds few."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys.astype(np.uint64), _LAST)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is not there."""
        at = self.first[hashes >> self.shift]
        todo = np.flatnonzero(self.keys[at] < hashes)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < hashes[todo]]
        return np.where((self.keys[at] == hashes) & (at < len(self)), at, np.int32(-1))


class Tally:
    """Adds up counts of 64-bit keys within a task; gives them out when many are held."""

    def __init__(self, hold: int = 1 << 19):
        self.hold, self.raw, self.n = hold, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray):
        self.raw.append(keys)
        self.n += len(keys)
        if self.n >= self.hold:
            self._merge()
            if len(self.keys) >= self.hold:
                yield self.take()

    def _merge(self) -> None:
        if not self.raw:
            return
        keys, counts = np.unique(np.concatenate(self.raw), return_counts=True)
        self.raw, self.n = [], 0
        if len(self.keys):
            both = np.concatenate([self.keys, keys])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], np.concatenate([self.counts, counts])[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            keys, counts = both[first], np.add.reduceat(counts, first)
        self.keys, self.counts = keys, counts.astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        found = self.keys, self.counts
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return found
