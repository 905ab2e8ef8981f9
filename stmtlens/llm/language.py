"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: how often a byte followed the bytes before it, for all
orders up to ``depth``. A byte costs what the longest known context says; where it never followed
that context, an escape is paid and the next shorter context asked, down to equal chances for all
bytes. A context's escape probability is q / (T + q) for T bytes seen after it, q of them different.
Statistics are frozen after training, so the code length of a text is a sum over its bytes, and
the language that codes a text shortest is predicted.

All training rows are counted. Orders 0 and 1 of every language are whole. Of higher orders a context
or byte stays in a language's tree if it makes up at least one part in ``2**share_bits`` of that
language's own training bytes, so an order holds at most that many entries a language, whatever the
size of the corpus: that bounds what is broadcast. A language of fewer bytes keeps everything, and how
much of a language is kept does not depend on the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.llm import contexts
from stmtlens.llm.common import batch, chunks, ids_and_texts
from stmtlens.session import discard, written

CHUNK_BYTES = 4 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Order:
    """One order of a language's tree: sorted (context, byte) codes with log2 probabilities, and
    sorted contexts with log2 escape probabilities."""

    codes: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


@dataclass(frozen=True)
class Model:
    depth: int
    languages: tuple[str, ...]
    orders: dict[str, tuple[Order, ...]]  # by language, from order 0 up


_COUNTED = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _gram_counts(rows: DataFrame, depth: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, contexts.Counter] = {}
        for own in batches:
            texts, langs = own["text"].to_pylist(), own["lang"].to_pylist()
            data = [text.encode() for text in texts]
            for lo, hi in chunks(data, CHUNK_BYTES):
                for lang in set(langs[lo:hi]):
                    some = [t for t, other in zip(data[lo:hi], langs[lo:hi]) if other == lang]
                    counters.setdefault(lang, contexts.Counter()).add(
                        contexts.codes(some, depth)[0]
                    )
        for lang, counter in counters.items():
            for values, counts in counter.batches():
                yield batch(
                    {"lang": [lang] * len(values), "code": values.view(np.int64), "n": counts},
                    _COUNTED,
                )

    counts = rows.mapInArrow(count, "lang string, code long, n long")
    return counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    depth: int = 3,
    share_bits: int = 20,
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn the trees of all languages from rows with a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    counts = written(_gram_counts(rows, depth), "grams")
    shares = counts.groupBy("lang").agg((F.sum("n") / 2**share_bits).alias("least"))
    shares = F.broadcast(shares)  # one row per language
    orders: dict[str, list[Order]] = {}
    for order in range(depth + 1):
        mask = (1 << 8 * (order + 1)) - 1
        seen = counts.groupBy("lang", F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(
            F.sum("n").alias("n")
        )
        context = F.shiftright("code", 8)
        sums = seen.groupBy("lang", context.alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
        )
        least = F.col("least") if order > 1 else F.lit(0.0)
        whole = F.col("total") + F.col("kinds")
        contexts_kept = sums.join(shares, "lang").where(F.col("total") >= least).select(
            "lang", F.lit(None).cast("long").alias("code"), "context",
            F.log2(F.col("kinds") / whole).alias("bits"),
        )
        codes_kept = (
            seen.join(shares, "lang").where(F.col("n") >= least).withColumn("context", context)
            .join(sums, ["lang", "context"])
            .select("lang", "code", "context", F.log2(F.col("n") / whole).alias("bits"))
        )
        for lang, own in _by_language(contexts_kept.unionByName(codes_kept)).items():
            orders.setdefault(lang, []).append(own)
    discard(counts)
    # Higher orders of a language may be empty, never the lower ones.
    known = {lang: tuple(own) for lang, own in orders.items()}
    return Model(depth, tuple(sorted(known)), known)


def _by_language(tree: DataFrame) -> dict[str, Order]:
    """Bring one order's kept entries to the driver; the shares bound their number."""
    got = tree.toArrow()
    made = {}
    for lang in pc.unique(got["lang"]).to_pylist():
        own = got.filter(pc.equal(got["lang"], lang))
        parts = []
        for rows, name in (
            (own.filter(pc.is_valid(own["code"])), "code"),
            (own.filter(pc.is_null(own["code"])), "context"),
        ):
            keys = rows[name].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            parts += [keys[order], rows["bits"].to_numpy()[order]]
        made[lang] = Order(*parts)
    return made


def costs(model: Model, lang: str, found: np.ndarray) -> np.ndarray:
    """Bits that each code costs in a language."""
    bits = np.zeros(len(found))
    open_ = np.ones(len(found), dtype=bool)
    for order in reversed(range(len(model.orders[lang]))):
        own = model.orders[lang][order]
        code = found & np.uint64((1 << 8 * (order + 1)) - 1)
        at, hit = contexts.lookup(own.codes, code)
        hit &= open_
        bits[hit] -= own.bits[at[hit]]
        open_ &= ~hit
        at, known = contexts.lookup(own.contexts, code >> np.uint64(8))
        known &= open_
        bits[known] -= own.escapes[at[known]]
    bits[open_] += 8
    return bits


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text (rows) in each language (columns)."""
    found, sizes = contexts.codes(texts, model.depth)
    distinct, back = np.unique(found, return_inverse=True)
    return np.stack(
        [
            contexts.per_text(costs(model, lang, distinct)[back], sizes)
            for lang in model.languages
        ],
        axis=1,
    )


_PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each input row.

    ``score`` is the probability of the predicted language, all being equally likely before. Texts
    that are null or have no letter, and all texts if no language was learned, are ``und`` with
    score 0. Of languages with equal code lengths the first by name is predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows in batches:
            texts = rows["text"].to_pylist()
            data = [text.encode() for text in texts]
            for lo, hi in chunks(data, CHUNK_BYTES):
                langs, scores = [UNDETERMINED] * (hi - lo), np.zeros(hi - lo)
                some = [i for i in range(lo, hi) if any(c.isalpha() for c in texts[i])]
                if some and own.languages:
                    bits = code_lengths(own, [data[i] for i in some])
                    best = bits.argmin(axis=1)
                    ahead = np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0))
                    for i, k, chance in zip(some, best, 1 / ahead.sum(axis=1)):
                        langs[i - lo], scores[i - lo] = own.languages[k], chance
                yield batch(
                    {"doc_id": rows["doc_id"].slice(lo, hi - lo), "lang_pred": langs,
                     "score": scores},
                    _PREDICTED,
                )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        guess, "doc_id long, lang_pred string, score double"
    )


def fold(doc_id: Column, folds: int) -> Column:
    """The CRC-32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    said = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(said.cast("binary")) % folds


def held_out_predictions(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Train on all folds but one and predict all rows: adds ``held_out`` to the predictions."""
    model = train(docs.where(fold(F.col("doc_id"), folds) != held_out))
    out = (fold(F.col("doc_id"), folds) == held_out).alias("held_out")
    return predict(docs, model).select("doc_id", out, "lang_pred", "score")
