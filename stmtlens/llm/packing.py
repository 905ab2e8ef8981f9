"""Packing of documents into sequences of fixed length: concatenate and cut.

Pass one encodes each document once and writes the ids to the shared folder, together with the part
(the task that encoded it) and the token offset inside the part. Pass two sums the parts' totals
into base offsets, one row per part, so that every document knows its global offset; windows of
fixed length over that one long stream are the sequences. A document that crosses the edge of a
window is cut there; ``boundary_records`` lists these edges. Only the last sequence can be short.

The second pass is made of built-in functions: offsets, pieces and slices of the id bytes.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtlens.llm.common import batch, chunks, ids_and_texts
from stmtlens.session import written

# Bound of the word cache of a Python worker; a full cache is emptied and filled anew.
CACHED_WORDS = 1 << 19
CHUNK_BYTES = 4 << 20
ID_BYTES = 4

# Latin letters, without the two signs between them, are letters in any Unicode version; so for
# texts of these and ASCII the plain ``re`` module finds the same pieces as the tokenizer does.
_LETTER, _DIGIT = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9"
_OTHER_TEXT = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\\s{_LETTER}{_DIGIT}]+|\\s+(?!\\S)|\\s+"
)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: themselves if printable, else the
    next free letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _by_ranks(path: str, special: list[str]):
    """A faster encoder of single pieces from the same vocabulary file.

    It merges by id, which is the same if the file's merges make ever larger ids; None if not.
    """
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(pair)] for pair in merges]
    if made != sorted(set(made)):
        return None
    letters = _byte_letters()
    ranks = {
        bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special
    }
    return tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})


class WordCache:
    """Ids of whole texts, by the tokenizer's own pieces; each piece is encoded once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [
            token.content for token in self.tokenizer.get_added_tokens_decoder().values()
        ]
        self.ranks = _by_ranks(path, self.special)
        self.known: dict[str, bytes] = {}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self._encoded(pieces)
        one = self.ranks.encode_ordinary
        return [array("I", one(piece)).tobytes() for piece in pieces]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, one value per text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        plain = [
            not _OTHER_TEXT.search(text) and not any(s in text for s in self.special)
            for text in texts
        ]
        pieces = [_PIECE.findall(text) if ok else () for text, ok in zip(texts, plain)]
        missing = list(set().union(*pieces).difference(self.known))
        self.known.update(zip(missing, self._pieces(missing)))
        rest = iter(self._encoded([text for text, ok in zip(texts, plain) if not ok]))
        get = self.known.__getitem__
        return [b"".join(map(get, found)) if ok else next(rest) for found, ok in zip(pieces, plain)]


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())]
)


def encoded(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pass one, written to the shared folder: ``doc_id, part, at, ids``.

    ``ids`` ends with ``end_id``; a null text is an empty one. ``part`` and ``at`` (tokens of the
    part before this document) are fixed by the write: later reads see the same numbers, also if
    an executor is lost.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, at = word_cache(path), TaskContext.get().partitionId(), 0
        for rows in batches:
            texts, doc_ids = rows["text"].to_pylist(), rows["doc_id"]
            for lo, hi in chunks(texts, CHUNK_BYTES):
                ids = [x + end for x in cache.encode(texts[lo:hi])]
                sizes = np.array([len(x) // ID_BYTES for x in ids], dtype=np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part)),
                        pa.array(starts),
                        pa.array(ids, type=pa.binary()),
                    ],
                    schema=ENCODED,
                )

    found = ids_and_texts(docs, id_col, text_col).mapInArrow(
        encode, "doc_id long, part long, at long, ids binary"
    )
    return written(found, "encoded", compression="zstd")


def placed(ids: DataFrame) -> DataFrame:
    """Add ``first``: the number of tokens before each document in the whole stream.

    The window over parts sees one row per part (that is per task of pass one), never the documents.
    """
    size = F.length("ids") / ID_BYTES
    totals = ids.groupBy("part").agg(F.sum(size.cast("long")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")
    )
    return ids.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("first"),
        size.cast("long").alias("doc_tokens"), "ids",
    )


def pieces(stream: DataFrame, length: int) -> DataFrame:
    """Cut placed documents at the multiples of ``length``.

    One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (the id bytes).
    """
    first, last = F.col("first"), F.col("first") + F.col("doc_tokens") - 1
    window = F.floor(last / length).cast("long")
    cut = stream.select(
        "*", F.explode(F.sequence(F.floor(first / length).cast("long"), window)).alias("sequence_id")
    )
    lo = F.greatest(first, F.col("sequence_id") * length)
    hi = F.least(last + 1, (F.col("sequence_id") + 1) * length)
    return cut.select(
        "doc_id",
        (lo - first).alias("start"),
        (hi - lo).alias("length"),
        "doc_tokens",
        "sequence_id",
        (lo - F.col("sequence_id") * length).alias("offset"),
        F.substring(
            "ids", ((lo - first) * ID_BYTES + 1).cast("int"), ((hi - lo) * ID_BYTES).cast("int")
        ).alias("ids"),
    )


def boundary_records(stream: DataFrame, length: int) -> DataFrame:
    """Edges of windows that cut a document: ``sequence_id`` begins at ``start`` of ``doc_id``."""
    cut = pieces(stream, length).where("start > 0")
    return cut.select("sequence_id", "doc_id", "start")


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    length: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens.

    Each row of the input is a document of its own, also with a null or repeated id. Empty texts
    still have their end token. An empty table gives no pieces.
    """
    return pieces(placed(encoded(docs, path, end_id, id_col, text_col)), length)


def checked(cut: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their id bytes in place of the ids."""
    return cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
