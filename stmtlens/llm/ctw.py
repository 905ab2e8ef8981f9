"""Language-model scores by context-tree weighting over bytes, beside a word base line.

A byte is eight binary decisions, each with a context tree of its own: the decision's place in the
byte (its prefix) and the bytes before it. Every node holds the counts of both outcomes and their
Krichevsky-Trofimov estimate. The probability that the whole training text has at a node is half
its own estimate and half the product of its children's; from below upwards this gives each node's
weight for stopping there. With the statistics frozen, the probability of the next decision is the
mixture of the estimates along its context path under these weights; where the path ends early, in
a context that training never met, the last node takes the rest of the weight. A text's log
probability is a sum over its bytes.

Counts and weights use all training text and every context in it, and so do scores. A code is a byte
with the bytes before it. Codes are dealt into buckets by the ``TOP`` bytes next to the byte, so that
a bucket holds whole subtrees: everything from that depth down is worked out in its bucket, in arrays
sorted once. The levels above are small tables (one row per context of at most ``TOP`` bytes and
prefix), summed and settled with one join per level. Codes that only texts to be scored have take
part with a count of 0, which changes nothing and gives them their place in the tree.

Between blocks of documents and buckets travels one row of packed arrays for each pair of them, and
back come numbers alone, in the order of what was sent. Words of the base line go the same way.

A text is its words in lower case, joined by one blank, and an end byte: the events of the base line.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm import contexts
from stmtlens.llm.common import batch, block_count, chunks, in_blocks, runs, table
from stmtlens.llm.language import fold
from stmtlens.session import discard, written

CHUNK_BYTES = 4 << 20
LOG_HALF = math.log(0.5)
TOP = 3
# Rows between blocks and buckets grow with the product of both numbers, and the larger a block the
# more often a code or word occurs in it that is sent once: as few as there are partitions.
PER_PARTITION = 1
CODES, WORDS = 0, 1


def normal_form(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def _log_gamma(x, log):
    """Stirling's series eight steps up, where it is good to ten digits; of arrays or columns."""
    z, steps = x + 8, x
    for k in range(1, 8):
        steps = steps * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + series - log(steps)


def _log_estimate(zeros, ones, log):
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return (
        _log_gamma(zeros + 0.5, log) + _log_gamma(ones + 0.5, log)
        - _log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)
    )


# --- subtrees of one bucket -----------------------------------------------------------------------


class _Level:
    """Nodes of one depth, in the order of their keys: the prefix, then the bytes before, nearest first."""

    def __init__(self, keys, zeros, ones, below=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = _log_estimate(zeros, ones, np.log)
        self.inside = own if below is None else np.logaddexp(own, below) + LOG_HALF
        self.stop = np.ones(len(own)) if below is None else np.exp(own + LOG_HALF - self.inside)

    def settled(self, chance, rest, one):
        """Along the path to each node: the probability of outcome 1 from the nodes that stop, the
        weight left, and the probability if the path ends here; from the same of the nodes above."""
        known = self.zeros + self.ones > 0
        own = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        return (
            np.where(known, chance + rest * self.stop * own, chance),
            np.where(known, rest * (1 - self.stop), rest),
            np.where(known, chance + rest * own, one),
        )


class Subtrees:
    """All nodes from depth ``top`` down of some codes (sorted, distinct) and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top, self.n = depth, top, len(codes)
        byte = codes & np.uint64(255)
        before = np.zeros(len(codes), dtype=np.uint64)
        for k in range(1, depth + 1):
            before = before << np.uint64(8) | (codes >> np.uint64(8 * k)) & np.uint64(255)
        places = np.arange(8, dtype=np.uint64)[:, None]
        prefix = (np.uint64(1) << places) + (byte >> (np.uint64(8) - places))
        bit = ((byte >> (np.uint64(7) - places)) & np.uint64(1)).ravel().astype(bool)
        keys = (prefix << np.uint64(8 * depth) | before).ravel()
        self.order = np.argsort(keys)
        keys, self.bit = keys[self.order], bit[self.order]
        n = np.tile(counts.astype(np.float64), 8)[self.order]
        starts = runs(keys)
        self.sizes = np.diff(np.append(starts, len(keys)))
        ones = np.add.reduceat(np.where(self.bit, n, 0), starts) if len(starts) else n
        zeros = (np.add.reduceat(n, starts) if len(starts) else n) - ones
        level = _Level(keys[starts], zeros, ones)
        self.levels, self.children = [level], []
        for _ in range(top, depth):
            keys = level.keys >> np.uint64(8)
            starts = runs(keys)
            self.children.append(np.diff(np.append(starts, len(keys))))
            sums = [
                np.add.reduceat(x, starts) if len(starts) else x
                for x in (level.zeros, level.ones, level.inside)
            ]
            level = _Level(keys[starts], *sums)
            self.levels.append(level)

    def log_probabilities(self, chance: np.ndarray, rest: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Log10 probability of the byte of each code, from what is settled above the top nodes."""
        state = self.levels[-1].settled(chance, rest, one)
        for level, children in zip(self.levels[-2::-1], self.children[::-1]):
            state = level.settled(*(np.repeat(x, children) for x in state))
        one = np.repeat(state[2], self.sizes)
        found = np.empty(len(one))
        found[self.order] = np.log10(np.where(self.bit, one, 1 - one))
        return found.reshape(8, self.n).sum(axis=0)


def tree_log_probabilities(codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """Log10 probability of the byte of each code, with the whole tree in one place."""
    trees = Subtrees(codes, counts, depth, 0)
    n = len(trees.levels[-1].keys)
    return trees.log_probabilities(np.zeros(n), np.ones(n), np.full(n, 0.5))


def _bucket(codes: np.ndarray, top: int, buckets: int) -> np.ndarray:
    near = (codes >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1)
    near = (near + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(codes: np.ndarray, top: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the codes of each bucket, in their order."""
    bucket = _bucket(codes, top, buckets)
    order = np.argsort(bucket, kind="stable")
    for some in np.split(order, runs(bucket[order])[1:]) if len(order) else []:
        yield int(bucket[some[0]]), some


_COUNTED = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])


def _counted_codes(docs: DataFrame, depth: int, top: int, buckets: int) -> DataFrame:
    """``bucket, codes, counts``: each task's codes, counted in the texts that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, asked = contexts.Counter(), contexts.Counter()
        for rows in batches:
            out = rows["held_out"].to_pylist()
            data = [normal_form(text) for text in rows["text"].to_pylist()]
            for lo, hi in chunks(data, CHUNK_BYTES):
                for counter, wanted in ((learned, False), (asked, True)):
                    some = [t for t, o in zip(data[lo:hi], out[lo:hi]) if o == wanted]
                    if some:
                        counter.add(contexts.codes(some, depth, contexts.END)[0])
        parts = learned.parts + [(values, 0 * counts) for values, counts in asked.parts]
        if parts:
            codes, counts = contexts.counted(parts)
            for bucket, some in _by_bucket(codes, top, buckets):
                yield batch(
                    {"bucket": [bucket], "codes": [codes[some].tobytes()],
                     "counts": [counts[some].astype(np.int64).tobytes()]},
                    _COUNTED,
                )

    return docs.mapInArrow(count, "bucket int, codes binary, counts binary")


def _longs(packed: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=kind) for x in packed.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


_GROWN = pa.schema([*_COUNTED, ("tops", pa.binary())])
_TOPS = np.dtype([("key", "<i8"), ("zeros", "<f8"), ("ones", "<f8"), ("inside", "<f8")])


def _grown(counted: DataFrame, depth: int, top: int) -> DataFrame:
    """``bucket, codes, counts, tops``, one row per bucket: all its codes, and the nodes of depth
    ``top`` with what their subtrees say."""

    def grow(rows: pa.Table) -> pa.Table:
        codes, counts = contexts.counted(
            [(np.frombuffer(c, dtype=np.uint64), np.frombuffer(n, dtype=np.int64))
             for c, n in zip(rows["codes"].to_pylist(), rows["counts"].to_pylist())]
        )
        level = Subtrees(codes, counts, depth, top).levels[-1]
        tops = np.empty(len(level.keys), dtype=_TOPS)
        tops["key"] = level.keys
        for name in ("zeros", "ones", "inside"):
            tops[name] = getattr(level, name)
        return table(
            {"bucket": [rows["bucket"][0].as_py()], "codes": [codes.tobytes()],
             "counts": [counts.tobytes()], "tops": [tops.tobytes()]},
            _GROWN,
        )

    return counted.groupBy("bucket").applyInArrow(
        grow, "bucket int, codes binary, counts binary, tops binary"
    )


_NODES = pa.schema(
    [("bucket", pa.int32()), ("key", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()),
     ("inside", pa.float64())]
)


def _top_nodes(grown: DataFrame) -> DataFrame:
    """``bucket, key, zeros, ones, inside``, one row per node of the top depth."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for bucket, packed in zip(rows["bucket"].to_pylist(), rows["tops"].to_pylist()):
                tops = np.frombuffer(packed, dtype=_TOPS)
                columns = {name: tops[name] for name in _TOPS.names}
                yield batch({"bucket": np.full(len(tops), bucket), **columns}, _NODES)

    return grown.select("bucket", "tops").mapInArrow(
        spell, "bucket int, key long, zeros double, ones double, inside double"
    )


# --- levels above the buckets ---------------------------------------------------------------------


def _above(nodes: DataFrame) -> DataFrame:
    """Nodes one byte of context shorter: half the own estimate, half the children's product."""
    sums = nodes.groupBy(F.shiftright("key", 8).alias("key")).agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("inside").alias("below")
    )
    own = sums.withColumn("own", _log_estimate(F.col("zeros"), F.col("ones"), F.log))
    high, low = F.greatest("own", "below"), F.least("own", "below")
    both = high + F.log1p(F.exp(low - high)) + LOG_HALF
    return own.withColumn("inside", both).select(
        "key", "zeros", "ones", "inside", F.exp(F.col("own") + LOG_HALF - F.col("inside")).alias("stop")
    )


def _settled(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """``key, chance, rest, one`` of the nodes of a depth, as ``_Level.settled`` has them."""
    if above is None:
        own = nodes.withColumns({"chance": F.lit(0.0), "rest": F.lit(1.0), "one": F.lit(0.5)})
    else:
        up = above.withColumnRenamed("key", "up")
        own = nodes.withColumn("up", F.shiftright("key", 8)).join(up, "up")
    known = F.col("zeros") + F.col("ones") > 0
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    chance, rest, one = F.col("chance"), F.col("rest"), F.col("one")
    return own.select(
        "key",
        F.when(known, chance + rest * F.col("stop") * estimate).otherwise(chance).alias("chance"),
        F.when(known, rest * (1 - F.col("stop"))).otherwise(rest).alias("rest"),
        F.when(known, chance + rest * estimate).otherwise(one).alias("one"),
    )


_SCORES = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("scores", pa.binary())])


def _code_scores(docs: DataFrame, depth: int, top: int, buckets: int) -> DataFrame:
    """``bucket, codes, scores``, one row per bucket: log10 probability of every code's byte.

    ``docs`` has ``text`` and ``held_out``.
    """
    grown = written(_grown(_counted_codes(docs, depth, top, buckets), depth, top), "subtrees")
    tops = _top_nodes(grown)
    levels = [written(_above(tops), "levels")]
    for _ in range(top - 1):
        levels.append(written(_above(levels[-1]), "levels"))
    settled = None
    for level in reversed(levels):
        settled = written(_settled(level, settled), "settled")
    up = settled.withColumnRenamed("key", "up")
    asked = tops.select("bucket", "key", F.shiftright("key", 8).alias("up"))
    above = asked.join(up, "up").select("bucket", "key", "chance", "rest", "one")

    def score(own: pa.Table, settled: pa.Table) -> pa.Table:
        codes, counts = _longs(own["codes"]), _longs(own["counts"], np.int64)
        order = np.argsort(settled["key"].to_numpy())
        state = (settled[name].to_numpy()[order] for name in ("chance", "rest", "one"))
        found = Subtrees(codes, counts, depth, top).log_probabilities(*state)
        return table(
            {"bucket": own["bucket"].to_pylist(), "codes": own["codes"].to_pylist(),
             "scores": [found.tobytes()]},
            _SCORES,
        )

    both = grown.select("bucket", "codes", "counts").groupBy("bucket").cogroup(above.groupBy("bucket"))
    found = written(both.applyInArrow(score, "bucket int, codes binary, scores binary"), "code-scores")
    discard(grown, settled, *levels)
    return found


# --- blocks of documents --------------------------------------------------------------------------


_SENT = pa.schema(
    [("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()),
     ("counts", pa.binary())]
)
_ANSWERS = pa.schema(
    [("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()),
     ("new_words", pa.int64())]
)
_SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_words", pa.int64()),
        ("n_known", pa.int64()),
        ("log_counts", pa.float64()),
        ("score", pa.float64()),
        ("new_words", pa.int64()),
    ]
)


def _squeezed(codes: np.ndarray) -> bytes:
    """Rising codes as differences."""
    return zstandard.compress(np.diff(codes, prepend=np.uint64(0)).tobytes(), 1)


def _unsqueezed(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), dtype=np.uint64), dtype=np.uint64)


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Rising distinct codes; sorting beats hashing for as many."""
    codes = np.sort(codes)
    return codes[runs(codes)]


def _block_codes(data: list[bytes], depth: int) -> np.ndarray:
    parts = [
        _distinct(contexts.codes(data[lo:hi], depth, contexts.END)[0])
        for lo, hi in chunks(data, CHUNK_BYTES)
    ]
    return _distinct(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _scores_of(found: np.ndarray, codes: np.ndarray, scores: np.ndarray, depth: int) -> np.ndarray:
    """The score of each code, looked up in rising order: a code and its place are one number."""
    bits = min(64 - 8 * (depth + 1), 16)
    if bits < 8:
        return scores[np.searchsorted(codes, found)]
    out = np.empty(len(found))
    for lo in range(0, len(found), 1 << bits):
        part = found[lo : lo + (1 << bits)] << np.uint64(bits)
        part = np.sort(part | np.arange(len(part), dtype=np.uint64))
        place = (part & np.uint64((1 << bits) - 1)).astype(np.int64)
        out[lo + place] = scores[np.searchsorted(codes, part >> np.uint64(bits))]
    return out


def _words_by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the sorted words of each bucket, in their order."""
    bucket = np.array([zlib.crc32(word) % buckets for word in words], dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    for some in np.split(order, runs(bucket[order])[1:]) if len(order) else []:
        yield int(bucket[some[0]]), some


def _send(rows: pa.Table, depth: int, top: int, buckets: int) -> pa.Table:
    """Each code and each word of a block once, a row per bucket; words with their count in training
    texts (0 for held-out ones alone)."""
    split = [text.encode().lower().split() for text in rows["text"].to_pylist()]
    data = [b" ".join(words) for words in split]
    codes = _block_codes(data, depth)
    learned: Counter[bytes] = Counter()
    asked: set[bytes] = set()
    for words, held in zip(split, rows["held_out"].to_pylist()):
        if held:
            asked.update(words)
        else:
            learned.update(words)
    words = sorted(asked.union(learned))
    n = np.array([learned[word] for word in words], dtype=np.int64)
    found = [
        (CODES, bucket, _squeezed(codes[some]), b"")
        for bucket, some in _by_bucket(codes, top, buckets)
    ]
    for bucket, some in _words_by_bucket(words, buckets):
        own = b"\n".join([words[k] for k in some.tolist()])
        found.append((WORDS, bucket, zstandard.compress(own, 3), n[some].tobytes()))
    block = rows["block"][0].as_py()
    columns = dict(zip(("kind", "bucket", "keys", "counts"), zip(*found))) if found else {}
    return table(
        {"block": [block] * len(found), **{name: columns.get(name, []) for name in _SENT.names[1:]}},
        _SENT,
    )


def _answer(sent: pa.Table, scored: pa.Table) -> pa.Table:
    """For each row sent to a bucket, the scores of its codes or the training counts of its words.

    The first row of a bucket of words also says how many words of training it holds.
    """
    keys, new = sent["keys"].to_pylist(), [0] * sent.num_rows
    if not keys:
        return _ANSWERS.empty_table()
    if sent["kind"][0].as_py() == CODES:
        codes, scores = _longs(scored["codes"]), _longs(scored["scores"], np.float64)
        found = [
            scores[np.searchsorted(codes, _unsqueezed(packed))].astype(np.float32).tobytes()
            for packed in keys
        ]
    else:
        totals: dict[bytes, int] = {}
        for packed, n in zip(keys, sent["counts"].to_pylist()):
            for word, k in zip(zstandard.decompress(packed).split(b"\n"), np.frombuffer(n, np.int64).tolist()):
                totals[word] = totals.get(word, 0) + k
        found = [
            np.array([totals[word] for word in zstandard.decompress(packed).split(b"\n")], dtype=np.int64)
            .tobytes() for packed in keys
        ]
        new[0] = sum(k > 0 for k in totals.values())
    return table(
        {"block": sent["block"], "kind": sent["kind"], "bucket": sent["bucket"], "found": found,
         "new_words": new},
        _ANSWERS,
    )


def _rate(own: pa.Table, answers: pa.Table, depth: int, top: int, buckets: int) -> pa.Table:
    """Every row of a block with its sums; one row more tells the new words of its answers."""
    if not own.num_rows:
        return _SCORED.empty_table()
    told = {
        (kind, bucket): found
        for kind, bucket, found in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "found")))
    }
    split = [text.encode().lower().split() for text in own["text"].to_pylist()]
    data = [b" ".join(words) for words in split]
    codes = _block_codes(data, depth)
    scores = np.zeros(len(codes))
    for bucket, some in _by_bucket(codes, top, buckets):
        scores[some] = np.frombuffer(told[CODES, bucket], dtype=np.float32)
    words = sorted(set().union(*split))
    logs: dict[bytes, float] = {}
    for bucket, some in _words_by_bucket(words, buckets):
        counts = np.frombuffer(told[WORDS, bucket], dtype=np.int64)
        logs.update(zip([words[k] for k in some.tolist()], np.log10(counts + 1.0).tolist()))
    columns: dict[str, list] = {name: [] for name in _SCORED.names}
    columns["doc_id"], columns["held_out"] = own["doc_id"].to_pylist(), own["held_out"].to_pylist()
    n_words = np.array([len(own_words) for own_words in split], dtype=np.int64)
    each = np.fromiter(map(logs.__getitem__, chain.from_iterable(split)), np.float64, n_words.sum())
    columns["n_words"] = n_words.tolist()
    columns["n_known"] = contexts.per_text((each > 0).astype(np.float64), n_words).astype(np.int64).tolist()
    columns["log_counts"] = contexts.per_text(each, n_words).tolist()
    for lo, hi in chunks(data, CHUNK_BYTES):
        found, sizes = contexts.codes(data[lo:hi], depth, contexts.END)
        columns["score"] += contexts.per_text(_scores_of(found, codes, scores, depth), sizes).tolist()
    columns["new_words"] = [None] * len(data) + [sum(answers["new_words"].to_pylist())]
    for name in _SCORED.names[:-1]:
        columns[name].append(None)
    return table(columns, _SCORED)


def held_out_scores(
    docs: DataFrame, folds: int = 7, held_out: int = 2, depth: int = 5
) -> DataFrame:
    """Learn from all folds but one and score every row by the model and by the word base line.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text is empty
    and has its end token alone; a null id is in fold 0. Rows that repeat an id count each. If
    nothing is learned, every token has equal chances. An empty table gives no rows.

    Codes and words go to their buckets packed, once per block, and their scores and counts come back.
    Scores of codes travel as 32-bit numbers.
    """
    top = min(TOP, depth)
    buckets = block_count(docs.sparkSession, PER_PARTITION)
    out = fold(F.col("doc_id"), folds) == held_out
    dealt = in_blocks(docs, per_partition=PER_PARTITION).withColumn("held_out", out)
    scored = _code_scores(dealt.select("text", "held_out"), depth, top, buckets)
    sent = dealt.groupBy("block").applyInArrow(
        lambda rows: _send(rows, depth, top, buckets),
        "block int, kind int, bucket int, keys binary, counts binary",
    )
    by_kind = scored.withColumn("kind", F.lit(CODES)).groupBy("kind", "bucket")
    answers = sent.groupBy("kind", "bucket").cogroup(by_kind).applyInArrow(
        _answer, "block int, kind int, bucket int, found binary, new_words long"
    )
    rated = written(
        dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            lambda own, answers: _rate(own, answers, depth, top, buckets),
            "doc_id long, held_out boolean, n_words long, n_known long, log_counts double, "
            "score double, new_words long",
        ),
        "scores",
    )
    discard(scored)
    learned = F.col("held_out") == F.lit(False)
    sums = rated.agg(
        F.coalesce(F.sum(F.when(learned, F.col("n_words") + 1)), F.lit(0)).alias("train_tokens"),
        F.coalesce(F.sum(F.when(learned, 1)), F.lit(0)).alias("ends"),
        F.coalesce(F.sum("new_words"), F.lit(0)).alias("words"),
    ).first()
    tokens, ends = sums["train_tokens"], sums["ends"]
    kinds = sums["words"] + (1 if ends else 0)
    n_tokens = F.col("n_words") + 1
    return rated.where("new_words IS NULL").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + math.log10(ends + 1) - n_tokens * math.log10(tokens + kinds + 1))
        .alias("base_score"),
        "score",
    )
