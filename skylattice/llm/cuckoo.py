"""A cuckoo filter: a set of 64-bit keys in two bytes each, with insertion, deletion and batched look-up."""

from __future__ import annotations

import struct

import numpy as np

from skylattice.llm.textkernel import mix

_SLOTS = 4
_KICKS = 500
_HEAD = struct.Struct("<4sIQ")


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets.

    ``add`` gives False, and changes nothing, if there is no room for the key; the owner then
    builds a larger filter. A key may be added more than once and then takes as many removals.
    Only keys that were added may be removed. There are no false negatives.
    """

    def __init__(self, buckets: int) -> None:
        if buckets & buckets - 1 or buckets < 1:
            raise ValueError("the number of buckets must be a power of two")
        self.table = np.zeros((buckets, _SLOTS), np.uint16)
        self.count = 0

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """Room for ``n`` keys at a load of four fifths at most."""
        buckets = 16
        while buckets * _SLOTS * 4 < 5 * n:
            buckets *= 2
        return cls(buckets)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = mix(np.asarray(keys, np.uint64) + np.uint64(0x51ED270B))
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint; of that one, this one is the other."""
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def add(self, key: int) -> bool:
        prints, one, two = self._places(np.array([key], np.uint64))
        mark, moved = prints[0], []
        for bucket in (int(one[0]), int(two[0])):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                self.count += 1
                return True
        bucket, random = int(one[0]), np.random.default_rng(int(key) & 0xFFFFFFFF)
        for _ in range(_KICKS):
            slot = int(random.integers(_SLOTS))
            moved.append((bucket, slot, self.table[bucket, slot]))
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                self.count += 1
                return True
        for bucket, slot, old in reversed(moved):
            self.table[bucket, slot] = old
        return False

    def remove(self, key: int) -> bool:
        prints, one, two = self._places(np.array([key], np.uint64))
        for bucket in (int(one[0]), int(two[0])):
            found = np.flatnonzero(self.table[bucket] == prints[0])
            if len(found):
                self.table[bucket, found[0]] = 0
                self.count -= 1
                return True
        return False

    def to_bytes(self) -> bytes:
        return _HEAD.pack(b"CKF1", len(self.table), self.count) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        magic, buckets, count = _HEAD.unpack_from(data)
        if magic != b"CKF1":
            raise ValueError("not a cuckoo filter")
        out = cls(buckets)
        out.table = np.frombuffer(data, "<u2", offset=_HEAD.size).reshape(buckets, _SLOTS).astype(np.uint16)
        out.count = count
        return out


def build(keys: np.ndarray, buckets: int = 0) -> CuckooFilter:
    """A filter with all keys; it doubles until they fit."""
    keys = np.asarray(keys, np.uint64)
    while True:
        out = CuckooFilter(buckets) if buckets else CuckooFilter.for_keys(len(keys))
        if all(out.add(int(k)) for k in keys):
            return out
        buckets = 2 * len(out.table)
