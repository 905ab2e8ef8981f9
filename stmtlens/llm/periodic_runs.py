"""Runs of repeated word sequences, found with an enhanced suffix array.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. Each ends
in one branching square: two equal halves of ``q`` words, behind which the period breaks. Two
suffixes that start a half apart and differ right behind it meet in one LCP interval of depth ``q``,
in different children of it; so for each interval only the suffixes of all children but the largest
are taken, and for each of them the inverse suffix array says whether the suffix ``q`` words after
or before it lies in the interval too. The squares found are rotated to the left as far as the
period goes and merged into runs. The intervals come from the nearest smaller values of the LCP
array, so no tree is built.

The suffixes of many documents are sorted at once by prefix doubling, with the document as the
first key, and only while they are not told apart. The ranks of every round are kept: two steps
down through them give the length of any common prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import BLANKS, chunks, ids_and_texts, runs

CHUNK_BYTES = 2 << 20
SLICE = 1 << 21  # suffixes of small children looked at together
SPACE = r"[\x20\x09-\x0D]+"


class Suffixes:
    """Suffix array of several documents, word by word; a suffix ends with its document.

    ``ids`` numbers the words, document ``d`` has those from ``first[d]`` to ``first[d + 1]``.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        self.ids, self.n = ids, n
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start, self.end = first[doc], first[doc + 1]
        key = doc * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key)
        rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        slots = np.arange(n)
        tied = self._name(rank, order, key[order], slots)
        self.levels = [rank.copy()]  # of 1, 2, 4, ... words
        while len(tied):
            at = order[tied]
            beyond = at + (1 << len(self.levels) - 1)
            second = np.zeros(len(at), dtype=np.int64)
            inside = beyond < self.end[at]
            second[inside] = rank[beyond[inside]].astype(np.int64) + 1
            key = rank[at].astype(np.int64) * (n + 1) + second
            turn = np.argsort(key)
            order[tied] = at[turn]
            tied = self._name(rank, at[turn], key[turn], tied)
            self.levels.append(rank.copy())
        self.order, self.rank = order, rank
        #: Common prefix of each suffix with the one before it; -1 before the first and behind the last.
        self.lcp = np.full(n + 1, -1, dtype=np.int64)
        if n > 1:
            self.lcp[1:n] = self.common(order[:-1], order[1:])

    @staticmethod
    def _name(rank: np.ndarray, at: np.ndarray, key: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Rank sorted suffixes by the slot where their key starts; returns the slots of ties."""
        starts = runs(key)
        sizes = np.diff(np.append(starts, len(key)))
        rank[at] = np.repeat(slots[starts], sizes)
        return slots[np.repeat(sizes > 1, sizes)]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j`` (pairwise different) have in common."""
        length = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = i + length, j + length
            open_ = np.flatnonzero((a < self.end[i]) & (b < self.end[j]))
            same = self.levels[k][a[open_]] == self.levels[k][b[open_]]
            length[open_[same]] += 1 << k
        return length


class _Minima:
    """Nearest smaller values by a tree of minima."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(values) > 1:
            if len(values) % 2:
                values = np.append(values, values[-1])
                self.rows[-1] = values
            values = values.reshape(-1, 2).min(axis=1)
            self.rows.append(values)

    def nearest(self, at: np.ndarray, least: np.ndarray, after: bool) -> np.ndarray:
        """Nearest place before (or ``after``) each of ``at`` with a value below ``least``; there is one."""
        found = np.zeros(len(at), dtype=np.int64)
        at_level: list[np.ndarray] = []
        node, open_ = at.copy(), np.arange(len(at))
        for row in self.rows:
            side = node[open_] + (1 if after else -1)
            beside = (node[open_] & 1) == (0 if after else 1)
            hit = np.zeros(len(open_), dtype=bool)
            hit[beside] = row[side[beside]] < least[open_[beside]]
            found[open_[hit]] = side[hit]
            at_level.append(open_[hit])
            open_ = open_[~hit]
            node[open_] >>= 1
        down = np.zeros(0, dtype=np.int64)
        for level in range(len(self.rows) - 1, 0, -1):
            down = np.concatenate((down, at_level[level]))
            near = 2 * found[down] + (0 if after else 1)
            far = near ^ 1
            found[down] = np.where(self.rows[level - 1][near] < least[down], near, far)
        return found


def branching_squares(own: Suffixes, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and half of the squares behind which the period breaks; halves longer than one part in
    ``exponent`` of a document are left out."""
    none = np.zeros(0, dtype=np.int64)
    n, order, rank, ids = own.n, own.order, own.rank, own.ids
    if not n:
        return none, none
    depth = own.lcp[:n]
    longest = (own.end[order] - own.start[order]) // max(exponent, 2)
    bounds = np.flatnonzero((depth >= 1) & (depth <= longest))
    if not len(bounds):
        return none, none
    minima = _Minima(own.lcp)
    lo = minima.nearest(bounds, depth[bounds], after=False)
    hi = minima.nearest(bounds, depth[bounds], after=True)
    turn = np.lexsort((bounds, hi, lo))
    bounds, lo, hi = bounds[turn], lo[turn], hi[turn]
    heads = runs(lo * (n + 1) + hi)  # first boundary of each interval
    # Children: from the interval's start, and from each boundary in it.
    child = np.insert(bounds, heads, lo[heads])
    heads = heads + np.arange(len(heads))
    interval = np.zeros(len(child), dtype=np.int64)
    interval[heads[1:]] = 1
    interval = np.cumsum(interval)
    left, right = child[heads], hi[heads - np.arange(len(heads))]
    stop = np.append(child[1:], 0)
    stop[np.append(heads[1:], len(child)) - 1] = right
    size = stop - child
    far = depth[child[heads + 1]]
    largest = np.flatnonzero(size == np.maximum.reduceat(size, heads)[interval])
    small = np.ones(len(child), dtype=bool)
    small[largest[runs(interval[largest])]] = False
    child, size, interval = child[small], size[small], interval[small]

    starts, halves = [none], [none]
    for some in np.split(np.arange(len(child)), runs(np.cumsum(size) // SLICE)[1:]):
        within = np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        at = order[np.repeat(child[some], size[some]) + within]
        own_interval = np.repeat(interval[some], size[some])
        half, a, b = far[own_interval], left[own_interval], right[own_interval]
        for other in (at + half, at - half):
            there = np.flatnonzero((other >= own.start[at]) & (other < own.end[at]))
            there = there[(rank[other[there]] >= a[there]) & (rank[other[there]] < b[there])]
            square, q = np.minimum(at[there], other[there]), half[there]
            behind = square + 2 * q
            breaks = behind >= own.end[square]
            breaks[~breaks] = ids[behind[~breaks]] != ids[behind[~breaks] - q[~breaks]]
            starts.append(square[breaks])
            halves.append(q[breaks])
    found = np.unique(np.stack((np.concatenate(starts), np.concatenate(halves))), axis=1)
    return found[0], found[1]


def _rotated(ids: np.ndarray, first: int, at: int, q: int) -> int:
    """How far left of ``at`` the period ``q`` goes."""
    step = 64
    while at > first:
        lo = max(first, at - step)
        other = np.flatnonzero(ids[lo:at] != ids[lo + q : at + q])
        if len(other):
            return lo + int(other[-1]) + 1
        at, step = lo, 2 * step
    return first


def find_runs(
    ids: np.ndarray, first: np.ndarray, exponent: int = 4, length: int = 6
) -> np.ndarray:
    """Rows ``(start, length, period)``, by start and period: runs of at least ``exponent`` periods
    (two or more) and ``length`` words. Starts count from the first word of all documents."""
    own = Suffixes(ids, first)
    starts, halves = branching_squares(own, exponent)
    # Squares whose period does not go back far enough are no such run.
    whole = np.maximum(length, exponent * halves)
    back = starts + 2 * halves - whole
    fits = np.flatnonzero(back >= own.start[starts])
    periodic = own.common(back[fits], back[fits] + halves[fits]) >= (whole - halves)[fits]
    fits = fits[periodic]
    found: list[tuple[int, int, int]] = []
    ending: dict[int, list[tuple[int, int]]] = {}
    for k in fits[np.argsort(halves[fits], kind="stable")]:
        at, q = int(starts[k]), int(halves[k])
        end = at + 2 * q
        # Squares of a power of a shorter period end in the same run.
        if any(q % p == 0 and begin <= at for begin, p in ending.get(end, ())):
            continue
        begin = _rotated(ids, int(own.start[at]), at, q)
        ending.setdefault(end, []).append((begin, q))
        found.append((begin, end - begin, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def _collapsed(found: np.ndarray, n: int) -> np.ndarray:
    """Words that a run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _of_texts(texts: list[bytes], exponent: int, length: int) -> tuple[pa.Array, pa.Array]:
    split = [text.split() for text in texts]
    first = np.concatenate(([0], np.cumsum([len(words) for words in split]))).astype(np.int64)
    flat = pa.array([w for words in split for w in words], type=pa.large_binary())
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    found = find_runs(ids, first, exponent, length)
    doc = np.searchsorted(first, found[:, 0], "right") - 1
    offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    columns = [found[:, 0] - first[doc], found[:, 1], found[:, 2]]
    listed = pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_RUN))
    )
    gone = _collapsed(found, len(ids))
    kept = []
    for d, words in enumerate(split):
        if offsets[d] < offsets[d + 1]:
            words = [words[k] for k in np.flatnonzero(~gone[first[d] : first[d + 1]])]
        kept.append(b" ".join(words).decode())
    return listed, pa.array(kept, type=pa.string())


def collapse_runs(
    docs: DataFrame, exponent: int = 4, length: int = 6,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, runs, collapsed``, one row per input row.

    ``runs`` has ``start, length, period`` of every run of at least ``exponent`` periods (two or
    more) and ``length`` words, by start and period; ``collapsed`` the words, joined by one blank,
    without those that a run contains after its first period. Texts without words, and null texts,
    have no run. Null and repeated ids, and rows that repeat, are documents of their own. Other
    columns are left out. An empty table gives no rows. Texts are worked on whole; memory goes with
    the longest one (some 200 bytes a word).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [text.encode() for text in rows["text"].to_pylist()]
            for lo, hi in chunks(texts, CHUNK_BYTES):
                listed, kept = _of_texts(texts[lo:hi], exponent, length)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].slice(lo, hi - lo), listed, kept], schema=_FOUND
                )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(find, FOUND)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``, where every tenth text (by the CRC-32 of its id) gets a periodic end.

    With ``g`` the CRC-32 divided by ten, word ``i`` from ``a = g % n`` on becomes word
    ``a + (i - a) % p`` for ``p = 1 + (n - a) / (3 + g % 8)``. Rows without an id or without words
    stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.btrim("text", F.lit(BLANKS))

    def planted(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words).cast("long")
        cuts = F.struct((g % n).alias("a"), n.alias("n"), (3 + g % 8).alias("d"))

        def repeated(cut: Column) -> Column:
            a = cut["a"]
            p = 1 + F.floor((cut["n"] - a) / cut["d"])
            place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
            return F.array_join(
                F.transform(F.sequence(F.lit(0).cast("long"), cut["n"] - 1),
                            lambda i: F.get(words, place(i).cast("int"))), " ",
            )

        return _once(cuts, repeated)

    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0) & (bare != "")
    text = F.when(chosen, _once(F.split(bare, SPACE, -1), planted)).otherwise(F.col("text"))
    return ids_and_texts(docs, id_col, text_col).select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of collapsed documents."""
    # The greatest of (length, -start, -period).
    ranked = F.transform(
        "runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    )
    best = found.select("*", F.array_max(ranked).alias("best"))
    lines = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    )
    said = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    period = -F.col("best.p")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        period.alias("period"),
        F.floor(1000 * F.col("best.n") / period).cast("long").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
