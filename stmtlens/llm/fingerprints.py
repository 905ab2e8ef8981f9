"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes decides where a text is cut, so an edit moves only the cuts near
it. Cuts are normalised: up to the normal size a rarer hash pattern is asked for, beyond it a more
frequent one, and no chunk is longer than the largest size. The fingerprint is the set of chunk
digests with their lengths; likeness of two texts is the length that they share, as a part of the
shorter side (containment).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import block_count, table

WINDOW = 32  # bytes that the gear hash sees: one per bit of it
CHUNK_BYTES = 4 << 20
NO_ID = -(1 << 63)
TURN_BITS = 31


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes in bytes; ``smallest`` is not below the hash window, so that no cut depends on
    what stands before the text. ``normal`` is a power of two."""

    smallest: int = 32
    normal: int = 64
    largest: int = 256

    @property
    def bits(self) -> int:
        return self.normal.bit_length() - 1


GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the last 32 table values, each shifted by its age."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def cuts(texts: list[bytes], sizes: Sizes = Sizes()) -> list[list[int]]:
    """End offsets of the chunks of each text."""
    joined = b"".join(texts)
    h = gear_hashes(np.frombuffer(joined, dtype=np.uint8))
    # The top bits mix all bytes of the window. A position is the end (exclusive) of a chunk.
    often = np.flatnonzero(h >> np.uint32(32 - (sizes.bits - 2)) == 0) + 1
    rare = often[h[often - 1] >> np.uint32(32 - (sizes.bits + 2)) == 0].tolist()
    often = often.tolist()
    found, start = [], 0
    for text in texts:
        end, at, ends = start + len(text), start, []
        while end - at > sizes.smallest:
            first, normal, last = at + sizes.smallest, at + sizes.normal, at + sizes.largest
            k = bisect_right(rare, first - 1)
            cut = rare[k] if k < len(rare) and rare[k] <= normal else None
            if cut is None:
                k = bisect_right(often, normal)
                cut = often[k] if k < len(often) and often[k] <= last else last
            if cut >= end:
                break
            ends.append(cut - start)
            at = cut
        if end > at:
            ends.append(end - start)
        found.append(ends)
        start = end
    return found


def chunk_sets(texts: list[bytes], sizes: Sizes = Sizes()) -> list[dict[int, int]]:
    """Digest to length of each text's chunks; a repeated chunk counts once."""
    digest, found = xxhash.xxh3_64_intdigest, []
    for text, ends in zip(texts, cuts(texts, sizes)):
        at, own = 0, {}
        for end in ends:
            own[digest(text[at:end])] = end - at
            at = end
        found.append(own)
    return found


def written_out(own: dict[int, int]) -> str:
    """``digest:length`` pairs by digest; the empty text has none."""
    return " ".join(f"{digest:016x}:{size}" for digest, size in sorted(own.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared length as a part of the smaller set; two empty sets are alike, one alone is not."""
    if not a or not b:
        return float(a == b)
    shared = sum(size for digest, size in a.items() if digest in b)
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compared(rows: pa.Table, sizes: Sizes) -> pa.Table:
    """Rows of one part, each compared with the next by descending key, then hash and text."""
    keys, texts, turns = (rows[name].to_pylist() for name in ("key", "text", "turn"))
    carried, doc_ids = rows["carried"].to_pylist(), rows["doc_id"].to_pylist()
    # The carried row is the first of the following part and so comes last, whatever its key.
    order = sorted(range(len(keys)), key=lambda i: (carried[i], -keys[i], turns[i], texts[i]))
    columns: dict[str, list] = {name: [] for name in RESULT.names}
    at = 0
    while at < len(order) - 1:
        held, stop = 0, at
        while stop < len(order) - 1 and held < CHUNK_BYTES:
            held += len(texts[order[stop]])
            stop += 1
        some = order[at : stop + 1]
        own = [texts[i] for i in some]
        changed = [edited(a, b) for a, b in zip(own, own[1:])]
        data = [x.encode() for x in own + changed]
        sets = chunk_sets(data, sizes)
        for k, i in enumerate(some[:-1]):
            new = len(own) + k
            columns["doc_id"].append(doc_ids[i])
            columns["n_chars"].append(len(texts[i]))
            columns["edited_sha256"].append(hashlib.sha256(data[new]).hexdigest())
            columns["fingerprint"].append(written_out(sets[k]))
            columns["edited_fingerprint"].append(written_out(sets[new]))
            columns["near_edited"].append(containment(sets[k], sets[new]))
            columns["near_next"].append(containment(sets[k], sets[k + 1]))
        at = stop
    return table(columns, RESULT)


def _part_of(edges: list[int]):
    """Column function of key and turn: number of the part, from 0 for the largest keys down.

    Keys between two edges are one part. An edge that the quantiles name several times is a key
    with as many parts' worth of rows; its rows are cut into as many parts by their turn.
    """
    ordered, named = np.unique(np.array(edges, dtype=np.int64), return_counts=True)
    slices = np.concatenate(([0], np.where(named > 1, named, 0)))  # bin 0 lies below all edges
    width = slices + 1
    first = np.cumsum(width[::-1])[::-1] - width

    @F.pandas_udf("int")
    def part(keys: pd.Series, turns: pd.Series) -> pd.Series:
        values = keys.to_numpy()
        at = np.searchsorted(ordered, values, side="right")
        hot = np.zeros(len(values), dtype=bool)
        if len(ordered):
            hot = (slices[at] > 0) & (ordered[at - 1] == values)
        place = 1 + (turns.to_numpy() * slices[at] >> TURN_BITS)
        return pd.Series(first[at] + np.where(hot, place, 0))

    return part


def with_neighbours(
    docs: DataFrame, sizes: Sizes = Sizes(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint each document and its edited text, and compare both with it.

    The next document has the next smaller id (equal ids: the next turn, a hash of the text, and
    then text); after the last comes the first. A null id counts as the smallest, a null text as
    empty. One document alone is its own next one; an empty table gives no rows.

    Ids are cut into parts by approximate quantiles, and an id of very many rows further by turn. A
    part only misses the document that follows its last one, so the first row of each part is sent
    along to the part before it: one row per part. The texts are shuffled once.
    """
    parts = block_count(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(text_col, F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
    ).withColumn("turn", F.shiftrightunsigned(F.xxhash64("text"), 64 - TURN_BITS))
    steps = [i / parts for i in range(1, parts)]
    found = rows.select("key").agg(F.percentile_approx("key", steps, 100 * parts)).first()[0]
    rows = rows.withColumn("part", _part_of(found or [])("key", "turn"))
    # A part's first row: its largest key, then the smallest turn and text.
    place = F.struct(F.bitwise_not("key").alias("down"), "turn")
    tops = rows.groupBy("part").agg(F.min(place).alias("top")).select(
        "part", F.bitwise_not("top.down").alias("key"), "top.turn"
    )
    heads = (
        rows.join(F.broadcast(tops), ["part", "key", "turn"])
        .groupBy("part", "key", "turn")
        .agg(F.min("text").alias("text"))
    )
    used = sorted(row["part"] for row in tops.collect())
    before = {part: used[i - 1] for i, part in enumerate(used)}
    pairs = docs.sparkSession.createDataFrame(
        [(part, to) for part, to in before.items()], "part int, goes_to int"
    )
    carried = heads.join(F.broadcast(pairs), "part").select(
        F.lit(None).cast("long").alias("doc_id"), "text", "key", "turn",
        F.col("goes_to").alias("part"), F.lit(True).alias("carried"),
    )
    both = rows.withColumn("carried", F.lit(False)).unionByName(carried)
    return both.groupBy("part").applyInArrow(
        lambda rows: _compared(rows, sizes),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
