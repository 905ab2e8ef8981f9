"""SimHash near-dedup with pivot distance tables.

A pivot table holds the Hamming distances of each fingerprint to reference fingerprints. Two kinds
of references are used. The distances to the origin and to the 64 unit fingerprints differ by one
for each bit, so they say in which of four groups of sixteen pivots two fingerprints have no
difference at all; at most two differing bits leave two groups without one, and each of the six
pairs of groups is a bucket key. Within a bucket, the distances to random references follow: by the
triangle inequality a pair is discarded if any coordinate differs by more than the limit. Survivors
are verified by their own distance. A wider limit takes more groups, two more than bits may differ.

Copies are one fingerprint before any of this. Buckets give star links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlens.llm.common import batch, chunks, ids_and_texts, runs
from stmtlens.llm.graph import local_roots, roots
from stmtlens.session import written

SEED = 42
LIMIT = 2
KEPT = 2  # groups of bits in a bucket key; of KEPT more than may differ, so many are equal
CHUNK_BYTES = 4 << 20
# Buckets with more fingerprints take the exact way whose work is linear in their size.
PAIRWISE = 1 << 13
NEIGHBOURS = 1 << 22  # neighbours of fingerprints that are sorted at a time
REFERENCES = np.array(
    [xxhash.xxh64_intdigest(b"pivot", seed=k) for k in range(12)], dtype=np.uint64
)


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(joined, SEED)]
    starts, ends, at = [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    return [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingle hashes; no words give 0."""
    hashes = [shingle_hashes(text, width) for text in texts]
    counts = np.array([len(own) for own in hashes], dtype=np.int64)
    flat = np.array([h for own in hashes for h in own], dtype="<u8")
    found = np.zeros(len(texts), dtype="<u8")
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[some]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        majority = 2 * votes > counts[some, None]
        found[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return found


_PRINTED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long), one row per input row; null texts are empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [text.encode() for text in rows["text"].to_pylist()]
            for lo, hi in chunks(texts, CHUNK_BYTES):
                found = fingerprints(texts[lo:hi]).view(np.int64)
                yield batch({"doc_id": rows["doc_id"].slice(lo, hi - lo), "fp": found}, _PRINTED)

    return ids_and_texts(docs, id_col, text_col).mapInArrow(compute, "doc_id long, fp long")


def distances(fps: np.ndarray, references: np.ndarray = REFERENCES) -> np.ndarray:
    """The pivot table: one row per reference, one column per fingerprint."""
    return np.bitwise_count(fps[None, :] ^ references[:, None]).astype(np.int8)


def bucket_masks(limit: int = LIMIT) -> list[int]:
    groups = limit + KEPT
    edges = [64 * k // groups for k in range(groups + 1)]
    group = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(group[k] for k in kept) for kept in combinations(range(groups), KEPT)]


def _near_pairs(
    fps: np.ndarray, run: np.ndarray, limit: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions among neighbours of the same run, one distance in the array at a time."""
    table = distances(fps)
    at = np.arange(len(fps))
    step = 1
    while len(at):
        at = at[at + step < len(fps)]
        at = at[run[at] == run[at + step]]
        left, right = at, at + step
        for row in table:
            close = np.abs(row[left] - row[right]) <= limit
            left, right = left[close], right[close]
        near = np.bitwise_count(fps[left] ^ fps[right]) <= limit
        yield left[near], right[near]
        step += 1


def _ball_links(fps: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one large bucket in linear work, for an even limit.

    Two fingerprints within the limit have a common neighbour at most half of it from both; the
    members of each such neighbourhood are chained. Neighbours are made in parts, told apart by the
    bits that divide the bucket best.
    """
    differing = int(np.bitwise_or.reduce(fps ^ fps[0]))
    moving = [bit for bit in range(64) if differing >> bit & 1]
    near = [sum(1 << bit for bit in chosen) for size in range(limit // 2 + 1)
            for chosen in combinations(moving, size)]
    flips = np.array(near, dtype=np.uint64)
    ones = {bit: np.count_nonzero(fps & np.uint64(1 << bit)) for bit in moving}
    parts = (len(flips) * len(fps) // NEIGHBOURS).bit_length()
    dividing = sorted(moving, key=lambda bit: abs(2 * ones[bit] - len(fps)))[:parts]
    mask = np.uint64(sum(1 << bit for bit in dividing))
    order = np.argsort(fps & mask, kind="stable")
    values, starts = np.unique((fps & mask)[order], return_index=True)
    members = dict(zip(values.tolist(), np.split(order, starts[1:])))
    moved = flips & mask
    for part in np.unique(values[:, None] ^ np.unique(moved)).tolist():
        around, owner = [], []
        for flip, other in zip(flips, moved.tolist()):
            if (at := members.get(part ^ other)) is not None:
                around.append(fps[at] ^ flip)
                owner.append(at)
        around, owner = np.concatenate(around), np.concatenate(owner)
        order = np.argsort(around, kind="stable")
        same = np.flatnonzero(around[order][1:] == around[order][:-1])
        yield owner[order][same], owner[order][same + 1]


def bucket_links(
    fps: np.ndarray, run: np.ndarray, limit: int = LIMIT
) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest position) of the linked fingerprints of each run."""
    n = len(fps)
    root = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        root = local_roots(n, np.concatenate((a, np.arange(n))), np.concatenate((b, root)))

    starts = runs(run)
    sizes = np.diff(np.append(starts, n))
    large = sizes > PAIRWISE
    for start, size in zip(starts[large], sizes[large]):
        for a, b in _ball_links(fps[start : start + size], limit):
            join(a + start, b + start)
    small = np.flatnonzero(np.repeat(~large, sizes))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in _near_pairs(fps[small], run[small], limit):
        held.append((small[a], small[b]))
        if sum(len(x) for x, _ in held) > 4 * n + (1 << 16):
            join(*map(np.concatenate, zip(*held)))
            held.clear()
    if held:
        join(*map(np.concatenate, zip(*held)))
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that connect all within the limit.

    The limit is an even number of bits.

    Rows reach Python sorted by bucket; a bucket that goes on in the next batch is carried over.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, run = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        before, number = None, 0

        def found(fps: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
            member, root = bucket_links(fps, run, limit)
            return batch(
                {"a": fps[member].view(np.int64), "b": fps[root].view(np.int64)}, _LINKS
            )

        for rows in batches:
            if not rows.num_rows:
                continue
            mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
            new = np.ones(len(mask), dtype=bool)
            new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
            new[0] = before != (mask[0], key[0])
            numbers = number + np.cumsum(new)
            before, number = (mask[-1], key[-1]), int(numbers[-1])
            fps = np.concatenate((fps, rows["fp"].to_numpy().view(np.uint64)))
            run = np.concatenate((run, numbers))
            done = run < number
            if done.any():
                yield found(fps[done], run[done])
                fps, run = fps[~done], run[~done]
        if len(fps):
            yield found(fps, run)

    masks = [m - (1 << 64) if m >> 63 else m for m in bucket_masks(limit)]
    each = prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    keyed = each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    bucket = Window.partitionBy("mask", "key")
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")
    return shared.select("mask", "key", "fp").mapInArrow(scan, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id among all documents that links reach.

    One row per input row. Documents of equal fingerprint are linked; texts without words have
    fingerprint 0 and are linked like any other. Null ids are never the smallest: a component of
    documents without ids has a null id. An empty table gives no rows.
    """
    rows = written(fingerprinted(docs, id_col, text_col), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = roots(links(prints.select("fp")))
    linked = prints.join(rooted, prints["fp"] == rooted["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(whole, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
