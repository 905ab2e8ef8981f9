"""Substring dedup over word windows, by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the smallest hash of the word triples in
it; equal windows have equal minimisers, and neighbouring windows mostly share theirs. A run of
windows of one document with the same minimiser, a super-k-mer, travels as one packed string (the
words it spans) to the bucket of its minimiser. There the windows are unpacked and sorted, so equal
ones meet and are counted exactly.

A block of documents sends each packed string once, with the smallest and largest id that holds it,
however many of its documents repeat it; all strings for one bucket are one compressed value. A
bucket answers only for strings that have a window with an owner smaller than the largest id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import block_count, in_blocks, runs, table

TRIPLE = 3
# A block sends at most one row to each bucket, so rows grow with the product of both numbers (and
# never beyond the number of super-k-mers): fewer and larger ones than elsewhere.
PER_PARTITION = 2
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of several documents, one after the other, blanks between them."""

    data: bytes
    starts: np.ndarray  # byte offsets of the words
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and one past the last document's

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        split = [text.encode().split() for text in texts]
        flat = [word for words in split for word in words]
        lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        ends = np.cumsum(lengths + 1) - 1
        first = np.concatenate(([0], np.cumsum([len(words) for words in split]))).astype(np.int64)
        return cls(b" ".join(flat), ends - lengths, ends, first)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word, from prefix sums over the bytes."""
        data = np.frombuffer(self.data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(data * _powers(_BASE, len(data)), out=sums[1:])
        back = _powers(_BASE_INVERSE, len(data) + 1)
        return _mixed((sums[self.ends] - sums[self.starts]) * back[self.starts])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each position on (positions near the end are cut off)."""
    best, have = values, 1
    while 2 * have <= width:
        best, have = np.minimum(best[: len(best) - have], best[have:]), 2 * have
    if have < width:
        rest = width - have
        best = np.minimum(best[: len(best) - rest], best[rest:])
    return best


@dataclass
class SuperKmers:
    """Runs of windows: documents, first and last window (word index), and minimiser."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    minimiser: np.ndarray


def super_kmers(words: Words, size: int) -> SuperKmers:
    n = len(words.starts)
    if n < size:
        none = np.zeros(0, dtype=np.int64)
        return SuperKmers(none, none, none, none.astype(np.uint64))
    h = words.hashes()
    turn = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
    triples = _mixed(
        sum((h[k : n - TRIPLE + 1 + k] * turn[k] for k in range(TRIPLE)), np.uint64(0))
    )
    smallest = _sliding_min(triples, size - TRIPLE + 1)
    counts = np.diff(words.first)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(smallest)]
    # Windows that end in the document they start in.
    valid = np.arange(len(smallest)) + size <= words.first[doc + 1]
    at = np.flatnonzero(valid)
    doc, smallest = doc[at], smallest[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (smallest[1:] != smallest[:-1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(at)) - 1
    return SuperKmers(doc[starts], at[starts], at[stops], smallest[starts])


def packed(words: Words, found: SuperKmers, size: int) -> list[bytes]:
    data = words.data
    spans = zip(words.starts[found.lo].tolist(), words.ends[found.hi + size - 1].tolist())
    return [data[a:b] for a, b in spans]


def _squeezed(strings: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(strings), 3)


SENT = "block int, bucket int, strings binary, low binary, high binary"
_SENT = pa.schema(
    [
        ("block", pa.int32()),
        ("bucket", pa.int32()),
        ("strings", pa.binary()),
        ("low", pa.binary()),
        ("high", pa.binary()),
    ]
)


def _send(rows: pa.Table, size: int, buckets: int) -> pa.Table:
    """The distinct super-k-mers of a block, one row per bucket."""
    named = [
        (doc_id, text)
        for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist())
        if doc_id is not None
    ]
    ids = [doc_id for doc_id, _ in named]
    words = Words.of([text for _, text in named])
    found = super_kmers(words, size)
    # Numbered by first sight, so that ids can be gathered in arrays.
    numbers: dict[bytes, int] = {}
    number = np.array(
        [numbers.setdefault(s, len(numbers)) for s in packed(words, found, size)], dtype=np.int64
    )
    owner = np.array(ids, dtype=np.int64)[found.doc]
    low = np.full(len(numbers), np.iinfo(np.int64).max)
    high = np.full(len(numbers), np.iinfo(np.int64).min)
    np.minimum.at(low, number, owner)
    np.maximum.at(high, number, owner)
    bucket = np.zeros(len(numbers), dtype=np.int64)
    bucket[number] = (found.minimiser % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    strings = list(numbers)
    block = rows["block"][0].as_py()
    out: dict[str, list] = {name: [] for name in _SENT.names}
    starts = runs(bucket[order])
    for at in np.split(order, starts[1:]) if len(starts) else []:
        out["block"].append(block)
        out["bucket"].append(int(bucket[at[0]]))
        out["strings"].append(_squeezed([strings[i] for i in at.tolist()]))
        out["low"].append(low[at].tobytes())
        out["high"].append(high[at].tobytes())
    return table(out, _SENT)


def _exact_order(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort windows (starting at ``at`` in the word numbers); starts of runs of equal ones.

    They are sorted by a hash of their word numbers, and neighbours with equal hashes compared word
    by word. Should two different windows ever share a hash, the words themselves are the sort key.
    """
    spread = _mixed(ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    turn = _powers(_BASE, size + 1)[1:]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        h += spread[at + k] * turn[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not _all_equal(ids, at[order], same, size):
        order = np.lexsort([ids[at + k] for k in range(size)])
        same = np.ones(max(len(at) - 1, 0), dtype=bool)
        for k in range(size):
            same &= ids[at[order][1:] + k] == ids[at[order][:-1] + k]
    return order, np.flatnonzero(np.concatenate(([True], ~same)))[: len(at)]


def _all_equal(ids: np.ndarray, at: np.ndarray, same: np.ndarray, size: int) -> bool:
    close = np.flatnonzero(same)
    return all((ids[at[close] + k] == ids[at[close + 1] + k]).all() for k in range(size))


ANSWER = "block int, strings binary, owners binary"
_ANSWER = pa.schema(
    [("block", pa.int32()), ("strings", pa.binary()), ("owners", pa.binary())]
)


def _count(rows: pa.Table, size: int) -> pa.Table:
    """The smallest owner of every window of a bucket, for the strings that need it."""
    blocks = rows["block"].to_pylist()
    parts = [zstandard.decompress(x) for x in rows["strings"].to_pylist()]
    low = np.frombuffer(b"".join(rows["low"].to_pylist()), dtype=np.int64)
    high = np.frombuffer(b"".join(rows["high"].to_pylist()), dtype=np.int64)
    sent = [len(x) // 8 for x in rows["low"].to_pylist()]
    data = b"\n".join(parts) + b"\n"
    letters = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero((letters == 32) | (letters == 10))
    last = np.flatnonzero(letters[ends] == 10)  # last word of each string
    starts = np.concatenate(([0], ends[:-1] + 1))
    # Exact word numbers: each value is a word and one blank behind it.
    offsets = np.append(starts, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(offsets), pa.py_buffer(data.replace(b"\n", b" "))],
    )
    ids = words.dictionary_encode().indices.to_numpy()
    n_words = np.diff(np.concatenate(([-1], last)))
    n_windows = n_words - size + 1
    string = np.repeat(np.arange(len(last)), n_windows)
    first_window = np.cumsum(n_windows) - n_windows
    at = np.arange(len(string)) - first_window[string] + (last - n_words + 1)[string]
    order, groups = _exact_order(ids, at, size)
    owner = np.empty(len(at), dtype=np.int64)
    if len(groups):
        smallest = np.minimum.reduceat(low[string[order]], groups)
        owner[order] = np.repeat(smallest, np.diff(np.append(groups, len(order))))
    needed = np.zeros(len(last), dtype=bool)
    needed[string[owner < high[string]]] = True
    block_of = np.repeat(np.arange(len(blocks)), sent)
    out: dict[str, list] = {name: [] for name in _ANSWER.names}
    string_start = starts[last - n_words + 1]
    string_end = ends[last]
    chosen = np.flatnonzero(needed)
    for some in np.split(chosen, runs(block_of[chosen])[1:]) if len(chosen) else []:
        spans = zip(string_start[some].tolist(), string_end[some].tolist())
        out["block"].append(blocks[block_of[some[0]]])
        out["strings"].append(_squeezed([data[a:b] for a, b in spans]))
        own = [owner[a:b] for a, b in zip(first_window[some], (first_window + n_windows)[some])]
        out["owners"].append(np.concatenate(own).tobytes())
    return table(out, _ANSWER)


_KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.string()),
    ]
)


def _rewrite(own: pa.Table, answers: pa.Table, size: int) -> pa.Table:
    owners: dict[bytes, np.ndarray] = {}
    for strings, values in zip(answers["strings"].to_pylist(), answers["owners"].to_pylist()):
        values, at = np.frombuffer(values, dtype=np.int64), 0
        for string in zstandard.decompress(strings).split(b"\n"):
            n = string.count(b" ") + 2 - size
            owners[string] = values[at : at + n]
            at += n
    ids = own["doc_id"].to_pylist()
    words = Words.of(own["text"].to_pylist())
    covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if owners:
        found = super_kmers(words, size)
        keys, docs, first = packed(words, found, size), found.doc.tolist(), found.lo.tolist()
        for key, doc, lo in zip(keys, docs, first):
            known = owners.get(key)
            if known is not None and ids[doc] is not None:
                at = lo + np.flatnonzero(known < ids[doc])
                np.add.at(covered, at, 1)
                np.add.at(covered, at + size, -1)
    gone = np.cumsum(covered[:-1]) > 0
    removed = np.concatenate(([0], np.cumsum(gone)))[words.first]
    starts, ends, data = words.starts.tolist(), words.ends.tolist(), words.data
    texts = []
    for lo, hi, n in zip(words.first[:-1].tolist(), words.first[1:].tolist(), np.diff(removed)):
        if lo == hi or n == hi - lo:
            texts.append("")
        elif n == 0:
            texts.append(data[starts[lo] : ends[hi - 1]].decode())
        else:
            left = np.flatnonzero(~gone[lo:hi]) + lo
            texts.append(b" ".join([data[starts[k] : ends[k]] for k in left.tolist()]).decode())
    return table(
        {
            "doc_id": ids, "n_words": np.diff(words.first), "n_removed": np.diff(removed),
            "kept_text": texts,
        },
        _KEPT,
    )


def drop_repeats(
    docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: texts without the words of repeated windows.

    A word goes if a window over it also starts in a document with a smaller id. All windows are
    judged on the input. Texts of fewer words than a window, and null texts (no words), lose
    nothing. Rows that repeat an id are one document. Documents without an id neither lose words
    nor cause others to. An empty table gives no rows.
    """
    buckets = block_count(docs.sparkSession, PER_PARTITION)
    dealt = in_blocks(docs, id_col, text_col, PER_PARTITION)
    sent = dealt.groupBy("block").applyInArrow(lambda rows: _send(rows, size, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(lambda rows: _count(rows, size), ANSWER)
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            lambda own, found: _rewrite(own, found, size),
            "doc_id long, n_words long, n_removed long, kept_text string",
        )
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
