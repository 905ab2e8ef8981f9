"""Line dedup that can be undone: sharded cuckoo filters before exact reference-count tables.

A line's key is the 128-bit digest of its normalised text. ``references`` say which documents of a
block hold a key: the exact table, from which documents can be taken out again. They are dealt into
shards by key. In a shard a cuckoo filter takes every key; only keys that the filter has met before
can have a second reference, so only these are counted exactly, and most keys never are.
Counts come to one row per (block, key) before the shuffle, so a line of a third of all documents
is as many rows as there are blocks.

A store is the pair of tables (references, filters). ``insert`` and ``delete`` change it by a batch of
documents; ``decisions`` and ``rewritten`` follow from it, and are those of a store that was built
from the remaining documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import BLANKS, block_count, block_of, in_blocks, runs, table
from stmtlens.llm.cuckoo import CuckooFilter, FilterStack

KEY_BYTES = 16
ROWS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Limits:
    """Lines of at least ``least_chars`` code points in at least ``least_docs`` documents go."""

    least_chars: int = 20
    least_docs: int = 3


def line_keys(text: str, limits: Limits) -> list[bytes | None]:
    """Key of each line, None for lines that are too short to count."""
    digest, found = xxhash.xxh3_128_digest, []
    for line in text.split("\n"):
        bare = line.strip(BLANKS)
        if len(bare) < limits.least_chars:
            found.append(None)
        else:
            found.append(digest(bare.encode().lower()))  # of bytes: A to Z alone
    return found


REFERENCES = "block int, key binary, docs array<long>, unnamed long"
_REFERENCES = pa.schema(
    [
        ("block", pa.int32()),
        ("key", pa.binary()),
        ("docs", pa.list_(pa.int64())),
        ("unnamed", pa.int64()),
    ]
)


def references(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text"):
    """``block, key, docs, unnamed``: ids of the block's documents that hold a key, each once, and
    how many documents without an id hold it (each such row is a document of its own)."""

    def collect(rows: pa.Table) -> pa.Table:
        held: dict[bytes, set] = {}
        unnamed: dict[bytes, int] = {}
        for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist()):
            for key in set(line_keys(text, limits)) - {None}:
                own = held.setdefault(key, set())
                if doc_id is None:
                    unnamed[key] = unnamed.get(key, 0) + 1
                else:
                    own.add(doc_id)
        block = rows["block"][0].as_py()
        return table(
            {
                "block": [block] * len(held), "key": list(held),
                "docs": [sorted(own) for own in held.values()],
                "unnamed": [unnamed.get(key, 0) for key in held],
            },
            _REFERENCES,
        )

    return in_blocks(docs, id_col, text_col).groupBy("block").applyInArrow(collect, REFERENCES)


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """Keys as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint64).reshape(-1, 2)


def _sharded(refs: DataFrame) -> DataFrame:
    shards = block_count(refs.sparkSession)
    return refs.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


DECISIONS = "block int, key binary, n_docs long, keeper long"
_DECISIONS = pa.schema(
    [("block", pa.int32()), ("key", pa.binary()), ("n_docs", pa.int64()), ("keeper", pa.int64())]
)


def _candidates(keys: np.ndarray, old: CuckooFilter | None = None) -> np.ndarray:
    """True for rows whose key may occur in more than one row.

    A first pass puts every key that the filter does not know into it and marks the others; the
    second pass finds the rows that came before the mark.
    """
    seen = old or CuckooFilter.sized(len(keys))
    met = np.zeros(len(keys), dtype=bool)
    for at in range(0, len(keys), ROWS_AT_ONCE):
        some = keys[at : at + ROWS_AT_ONCE, 0]
        known = seen.contains(some)
        fresh, first = np.unique(some, return_index=True)
        again = np.ones(len(some), dtype=bool)
        again[first] = False
        met[at : at + ROWS_AT_ONCE] = known | again
        new = fresh[~known[first]]
        if not seen.insert(new):
            seen = CuckooFilter.holding(np.unique(keys[: at + len(some), 0]))
    marked = CuckooFilter.holding(np.unique(keys[met, 0]))
    return marked.contains(keys[:, 0])


def decisions(refs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``block, key, n_docs, keeper`` for the keys of at least ``least_docs`` documents.

    ``keeper`` is the largest id that holds the key, null if no document with an id does.
    """

    def settle(rows: pa.Table) -> pa.Table:
        sizes = rows["docs"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        counts = sizes + rows["unnamed"].to_numpy()
        keys = _hashes(rows["key"])
        # One row can hold enough documents by itself.
        maybe = np.flatnonzero(_candidates(keys) | (counts >= limits.least_docs))
        some = rows.take(maybe)
        keys, counts = keys[maybe], counts[maybe]
        order = np.lexsort((keys[:, 0], keys[:, 1]))
        starts = runs(keys[order].view("V16").ravel())
        largest = np.array(
            [own[-1] if own else np.iinfo(np.int64).min for own in some["docs"].to_pylist()],
            dtype=np.int64,
        )
        if not len(starts):
            return table({name: [] for name in _DECISIONS.names}, _DECISIONS)
        totals = np.add.reduceat(counts[order], starts)
        keepers = np.maximum.reduceat(largest[order], starts)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        repeated = totals[group] >= limits.least_docs
        at, group = order[repeated], group[repeated]
        keeper = [None if k == np.iinfo(np.int64).min else int(k) for k in keepers[group]]
        return table(
            {
                "block": some["block"].take(at).to_pylist(),
                "key": some["key"].take(at).to_pylist(),
                "n_docs": totals[group], "keeper": keeper,
            },
            _DECISIONS,
        )

    return _sharded(refs).groupBy("shard").applyInArrow(settle, DECISIONS)


def rewritten(
    docs: DataFrame, decided: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text"
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text``: each text without its decided lines.

    Lines of a decided key stay in the document with the keeper's id (in all rows that repeat it).
    If only documents without an id hold the key, all of them keep it.
    """

    def rewrite(own: pa.Table, found: pa.Table) -> pa.Table:
        columns: dict[str, list] = {"doc_id": own["doc_id"].to_pylist()}
        texts = own["text"].to_pylist()
        left = _kept_lines(columns["doc_id"], texts, found, limits)
        columns["n_lines"] = [text.count("\n") + 1 for text in texts]
        columns["n_dropped"] = [n - len(kept) for n, kept in zip(columns["n_lines"], left)]
        columns["kept_text"] = ["\n".join(kept) for kept in left]
        return table(columns, _REWRITTEN)

    return (
        in_blocks(docs, id_col, text_col)
        .groupBy("block")
        .cogroup(decided.groupBy("block"))
        .applyInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, kept_text string")
    )


def _kept_lines(ids: list, texts: list[str], found: pa.Table, limits: Limits) -> list[list[str]]:
    keeper = dict(zip(found["key"].to_pylist(), found["keeper"].to_pylist()))
    left = []
    for doc_id, text in zip(ids, texts):
        lines = text.split("\n")
        if keeper:
            owners = [keeper.get(key) for key in line_keys(text, limits)]
            lines = [x for x, owner in zip(lines, owners) if owner is None or owner == doc_id]
        left.append(lines)
    return left


_REWRITTEN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_lines", pa.int64()),
        ("n_dropped", pa.int64()),
        ("kept_text", pa.string()),
    ]
)


def dedup(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text") -> DataFrame:
    """Line dedup of one table by itself.

    A null text is one empty line. Documents are told apart by id: rows that repeat an id are one
    document for the counts, rows without an id one each. An empty table gives no rows.
    """
    refs = references(docs, limits, id_col, text_col)
    return rewritten(docs, decisions(refs, limits), limits, id_col, text_col)


def with_kept_text(
    docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text"
) -> DataFrame:
    """``docs`` with the text of each row deduplicated, all its columns kept; null texts stay null."""
    blocks = block_count(docs.sparkSession)
    names, own_block = docs.columns, "_block"
    dealt = docs.withColumn(
        own_block, block_of(F.col(id_col).cast("long"), F.coalesce(text_col, F.lit("")), blocks)
    )
    refs = references(docs, limits, id_col, text_col)

    def rewrite(own: pa.Table, found: pa.Table) -> pa.Table:
        own = own.select(names)
        texts = own[text_col].to_pylist()
        left = _kept_lines(
            own[id_col].cast(pa.int64()).to_pylist(), [x or "" for x in texts], found, limits
        )
        new = [None if x is None else "\n".join(kept) for x, kept in zip(texts, left)]
        at = own.schema.get_field_index(text_col)
        return own.set_column(at, own.schema.field(at), pa.array(new, own.schema.field(at).type))

    decided = decisions(refs, limits).withColumnRenamed("block", own_block)
    return (
        dealt.groupBy(own_block)
        .cogroup(decided.groupBy(own_block))
        .applyInArrow(rewrite, docs.schema)
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


# --- a store that batches of documents are added to and taken from -------------------------------


@dataclass(frozen=True)
class LineStore:
    """``references`` (exact) and ``filters`` (``shard, cuckoo``: all keys that have a reference)."""

    references: DataFrame
    filters: DataFrame


FILTER = "shard int, cuckoo array<binary>"


def _filter_row(shard: int, made: FilterStack) -> pa.Table:
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "cuckoo": pa.array([made.to_bytes()], pa.list_(pa.binary())),
        }
    )


def _filters(keys: DataFrame) -> DataFrame:
    def build(rows: pa.Table) -> pa.Table:
        made = FilterStack.holding(np.unique(_hashes(rows["key"])[:, 0]))
        return _filter_row(rows["shard"][0].as_py(), made)

    return _sharded(keys).groupBy("shard").applyInArrow(build, FILTER)


def build_store(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text"):
    refs = references(docs, limits, id_col, text_col)
    return LineStore(refs, _filters(refs.select("block", "key").distinct()))


def _change_filters(filters: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Add keys to their shard's filter, or take them out; ``keys`` are distinct."""

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = (old if len(old) else new)["shard"][0].as_py()
        hashes = np.unique(_hashes(new["key"])[:, 0]) if len(new) else np.zeros(0, np.uint64)
        if not len(old):
            made = FilterStack.holding(hashes)
        else:
            made = FilterStack.from_bytes(old["cuckoo"][0].as_py())
            (made.delete if how == "delete" else made.insert)(hashes)
        return _filter_row(shard, made)

    left = filters.groupBy("shard")
    return left.cogroup(_sharded(keys).groupBy("shard")).applyInArrow(change, FILTER)


def _new_keys(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of a batch that the store has certainly no reference to, and ``maybe`` for the others."""

    def probe(old: pa.Table, new: pa.Table) -> pa.Table:
        if not len(new):
            known = np.zeros(0, dtype=bool)
        elif len(old):
            known = FilterStack.from_bytes(old["cuckoo"][0].as_py()).contains(
                _hashes(new["key"])[:, 0]
            )
        else:
            known = np.zeros(len(new), dtype=bool)
        return pa.table({"key": new["key"].cast(pa.binary()), "maybe": pa.array(known, pa.bool_())})

    pairs = filters.groupBy("shard").cogroup(_sharded(keys).groupBy("shard"))
    return pairs.applyInArrow(probe, "key binary, maybe boolean")


def insert(
    store: LineStore, docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text"
) -> LineStore:
    """The store with more documents; their ids must be new to it.

    Only keys that the filters may know are looked up in the exact table.
    """
    refs = references(docs, limits, id_col, text_col)
    probed = _new_keys(store.filters, refs.select("block", "key").dropDuplicates(["key"]))
    known = probed.where("maybe").join(store.references.select("key"), "key", "left_semi")
    fresh = probed.join(known.select("key"), "key", "left_anti").select("key")
    return LineStore(
        store.references.unionByName(refs), _change_filters(store.filters, fresh, "insert")
    )


def delete(store: LineStore, doc_ids: DataFrame, id_col: str = "doc_id") -> LineStore:
    """The store without the documents of the given ids (as if they had never been there)."""
    blocks = block_count(doc_ids.sparkSession)
    gone = (
        doc_ids.where(F.col(id_col).isNotNull())
        .select(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(blocks)).cast("int").alias("block"),
                F.col(id_col).cast("long").alias("_gone"))
        .distinct()
    )
    each = store.references.select(
        "block", "key", "unnamed", F.explode_outer("docs").alias("_doc")
    )
    left = each.join(
        gone, (each["block"] == gone["block"]) & (each["_doc"] == gone["_gone"]), "left_anti"
    )
    refs = (
        left.groupBy("block", "key")
        .agg(F.array_sort(F.collect_set("_doc")).alias("docs"), F.max("unnamed").alias("unnamed"))
        .where((F.size("docs") > 0) | (F.col("unnamed") > 0))
    )
    before, after = (x.select("key").distinct() for x in (store.references, refs))
    return LineStore(
        refs, _change_filters(store.filters, before.join(after, "key", "left_anti"), "delete")
    )
