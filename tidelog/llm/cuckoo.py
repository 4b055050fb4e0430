"""Cuckoo filters over 64-bit keys, in shards of bounded size, as arrays that test many keys at once."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


class CuckooFilter:
    """Buckets of SLOTS 16-bit fingerprints (0: free); a key may lie in one of two buckets, each of which tells the
    other.  insert() returns False when the filter is full: build a larger one from the exact table."""

    def __init__(self, capacity: int):
        n = 1
        while n * SLOTS * 0.85 < max(1, capacity):
            n *= 2
        self.table = np.zeros((n, SLOTS), dtype=np.uint16)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        return out

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _spread(keys.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = h & mask
        return prints, first.astype(np.int64), self._other(first, prints)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return ((place.astype(np.uint64) ^ _spread(prints.astype(np.uint64))) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Never false for a key that was inserted."""
        if not len(keys):
            return np.zeros(0, dtype=bool)
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Keys must be distinct and not inserted before."""
        for p, a, b in zip(*self._places(keys)):
            if not self._put(p, a, b):
                return False
        return True

    def _put(self, p: np.uint16, a: int, b: int) -> bool:
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = p
                return True
        place = a
        for kick in range(KICKS):
            slot = (kick + place) % SLOTS
            p, self.table[place, slot] = self.table[place, slot], p
            place = int(self._other(np.array([place]), np.array([p]))[0])
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = p
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Keys must have been inserted."""
        for p, a, b in zip(*self._places(keys)):
            for place in (a, b):
                found = np.flatnonzero(self.table[place] == p)
                if len(found):
                    self.table[place, found[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys; larger ones are tried until they fit."""
        room = len(keys)
        while True:
            out = cls(room)
            if out.insert(keys):
                return out
            room = 2 * max(1, room)
