"""A cuckoo filter over 64-bit hashes, in numpy: approximate membership with deletion.

An item has two buckets of four slots, each the other's partner by way of its 16-bit fingerprint.
Whole arrays are inserted at once: rounds place all that fit, and what does not fit swaps with a
resident and goes on to that one's other bucket. What a full filter leaves over goes into a further
one of the same size, where it has the same buckets, so nothing is ever refused.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
ROUNDS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = values * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _ranks(buckets: np.ndarray) -> np.ndarray:
    """Place of each item among the items of its bucket; ``buckets`` is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return np.arange(len(buckets)) - np.repeat(starts, np.diff(np.append(starts, len(buckets))))


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS) of uint16; 0 is a free slot

    @classmethod
    def sized(cls, items: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(items, 1) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def holding(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of the given hashes, as large as it takes."""
        size = len(hashes)
        while True:
            found = cls.sized(size)
            if found.insert(hashes):
                return found
            size = 2 * size

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _homes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _spread(hashes)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return (mixed & np.uint64(len(self.table) - 1)).astype(np.int64), prints

    def _partner(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = _spread(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)
        return buckets ^ step.astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """False is certain; True is wrong about once in 8,000 times."""
        first, prints = self._homes(hashes)
        second = self._partner(first, prints)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)

    def _place(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Fill free slots; True for the items that found one."""
        order = np.argsort(buckets, kind="stable")
        b, p = buckets[order], prints[order]
        rank = _ranks(b)
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        # The item of rank r takes the r-th free slot of its bucket.
        nth = np.cumsum(free, axis=1) == (rank + 1)[:, None]
        slot = np.argmax(nth & free, axis=1)
        self.table[b[fits], slot[fits]] = p[fits]
        placed = np.zeros(len(b), dtype=bool)
        placed[order[fits]] = True
        return placed

    def insert(self, hashes: np.ndarray) -> bool:
        """Add hashes (equal ones take a slot each); False if the filter is too full."""
        return not len(self.settle(*self._homes(hashes))[0])

    def settle(self, buckets: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place fingerprints, moving residents; gives back buckets and fingerprints left over."""
        for round_ in range(ROUNDS):
            if not len(buckets):
                break
            left = ~self._place(buckets, prints)
            buckets, prints = self._partner(buckets[left], prints[left]), prints[left]
            if round_ % 2 and len(buckets):
                # One item per bucket swaps with a resident and sends that one on.
                some, first = np.unique(buckets, return_index=True)
                slot = round_ // 2 % SLOTS
                gone = self.table[some, slot].copy()
                self.table[some, slot] = prints[first]
                prints[first] = gone
                buckets[first] = self._partner(some, gone)
        return buckets, prints

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Take out hashes that were inserted before, one slot each; True where a slot was found."""
        first, prints = self._homes(hashes)
        found = np.zeros(len(hashes), dtype=bool)
        for i, homes in enumerate(zip(first, self._partner(first, prints))):
            for bucket in homes:
                at = np.flatnonzero(self.table[bucket] == prints[i])
                if len(at):
                    self.table[bucket, at[0]] = 0
                    found[i] = True
                    break
        return found


class FilterStack:
    """Filters of one size, one behind the other, that grow with what is inserted."""

    def __init__(self, filters: list[CuckooFilter]):
        self.filters = filters

    @classmethod
    def holding(cls, hashes: np.ndarray) -> FilterStack:
        return cls([CuckooFilter.holding(hashes)])

    @classmethod
    def from_bytes(cls, tables: list[bytes]) -> FilterStack:
        return cls([CuckooFilter.from_bytes(data) for data in tables])

    def to_bytes(self) -> list[bytes]:
        return [f.to_bytes() for f in self.filters]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([f.contains(hashes) for f in self.filters])

    def insert(self, hashes: np.ndarray) -> None:
        left = self.filters[-1].settle(*self.filters[-1]._homes(hashes))
        while len(left[0]):
            self.filters.append(CuckooFilter(np.zeros_like(self.filters[-1].table)))
            left = self.filters[-1].settle(*left)

    def delete(self, hashes: np.ndarray) -> None:
        for f in self.filters:
            hashes = hashes[~f.delete(hashes)]
