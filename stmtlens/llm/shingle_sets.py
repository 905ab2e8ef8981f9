"""Shingle sets of texts, as sorted arrays of 64-bit hashes, and a hash of each whole set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import batch

SEED = 42


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: bytes, width: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(own))
    found = np.full(len(own) - width + 1 if width else 0, width, dtype=np.uint64)
    for k in range(width):
        found = found * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(found)]
        found ^= found >> np.uint64(32)
    return np.unique(found)


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def told_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, told, text``: ``told`` is a hash of the text; a null text is empty."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("told"), text.alias("text")
    )


_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def sets_of(texts: DataFrame, told: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the texts whose hash is in ``told``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for rows in batches:
            own = [shingles(text.encode(), width, hashes) for text in rows["text"].to_pylist()]
            yield batch(
                {"node": [node_of(x) for x in own], "shingles": [x.view(np.int64) for x in own]},
                _SETS,
            )

    some = texts.select("told", "text").join(told, "told", "left_semi").select("text")
    return some.mapInArrow(compute, "node long, shingles array<long>").dropDuplicates(["node"])
