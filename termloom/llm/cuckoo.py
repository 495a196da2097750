"""A cuckoo filter over 64-bit keys: 16-bit marks, four to a bucket, insertions and deletions."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


class CuckooFilter:
    def __init__(self, buckets: int) -> None:
        self.marks = np.zeros((max(2, buckets), SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds all keys, of the least power of two of buckets that takes them."""
        size = 1 << max(1, int(np.ceil(np.log2(max(2, len(keys) / SLOTS / 0.85)))))
        while True:
            out = cls(size)
            if all(out.insert(k) for k in keys.astype(np.uint64)):
                return out
            size *= 2

    @classmethod
    def load(cls, data: bytes, change: bool = False) -> CuckooFilter:
        """change: copies the marks, so that they can be changed."""
        out = cls(2)
        out.marks = np.frombuffer(data, np.uint16).reshape(-1, SLOTS)
        out.marks = out.marks.copy() if change else out.marks
        return out

    def dump(self) -> bytes:
        return self.marks.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = _mix(keys.astype(np.uint64))
        mark = ((mixed >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = mixed & np.uint64(len(self.marks) - 1)
        return mark, first.astype(np.int64), self._other(first, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return ((place.astype(np.uint64) ^ _mix(mark.astype(np.uint64))) & np.uint64(len(self.marks) - 1)).astype(np.int64)

    def insert(self, key: int) -> bool:
        """False where the table is too full; one mark is then lost, so build it again, larger."""
        mark, first, second = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (first, second):
            free = np.flatnonzero(self.marks[at] == 0)
            if len(free):
                self.marks[at, free[0]] = mark
                return True
        at = first
        for kick in range(KICKS):
            slot = (int(mark) + kick) % SLOTS
            mark, self.marks[at, slot] = self.marks[at, slot], mark
            at = int(self._other(np.array([at]), np.array([mark]))[0])
            free = np.flatnonzero(self.marks[at] == 0)
            if len(free):
                self.marks[at, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Takes one mark of a key that was inserted before."""
        mark, first, second = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (first, second):
            found = np.flatnonzero(self.marks[at] == mark)
            if len(found):
                self.marks[at, found[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be held; never False for a key that is."""
        mark, first, second = self._places(keys)
        return ((self.marks[first] == mark[:, None]) | (self.marks[second] == mark[:, None])).any(axis=1)
