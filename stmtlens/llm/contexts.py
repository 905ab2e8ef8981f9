"""Byte contexts: each byte of a text with the bytes before it, as one number, and their counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Stands before the first byte of a text; also a byte of its own that UTF-8 never uses at its end.
BEFORE = b"\x00"
END = b"\xff"


def codes(texts: list[bytes], depth: int, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """One number per byte (the byte lowest, the ``depth`` bytes before it above) and text sizes."""
    pad = BEFORE * depth
    joined = np.frombuffer(b"".join([pad + text + end for text in texts]), dtype=np.uint8)
    sizes = np.array([len(text) + len(end) for text in texts], dtype=np.int64)
    found = joined.astype(np.uint64)
    for k in range(1, depth + 1):
        found[k:] |= joined[:-k].astype(np.uint64) << np.uint64(8 * k)
    starts = np.cumsum(sizes + depth) - sizes - depth
    inside = np.ones(len(joined), dtype=bool)
    for k in range(depth):
        inside[starts + k] = False
    return found[inside], sizes


def counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge counted codes."""
    values = np.concatenate([v for v, _ in found])
    counts = np.concatenate([n for _, n in found])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Counter:
    """Counts codes of many texts; keeps one entry per distinct code."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, found: np.ndarray) -> None:
        self.parts.append(np.unique(found, return_counts=True))
        self.size += len(self.parts[-1][0])
        if len(self.parts) > 8 and self.size > 4 * len(self.parts[0][0]):
            self.parts = [counted(self.parts)]
            self.size = len(self.parts[0][0])

    def batches(self, rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            values, counts = counted(self.parts)
            for at in range(0, len(values), rows):
                yield values[at : at + rows], counts[at : at + rows]


def lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, table[at] == wanted


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's values; texts without bytes get 0."""
    total = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        total[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return total
