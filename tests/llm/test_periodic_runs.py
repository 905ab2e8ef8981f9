"""Periodic runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from stmtlens.llm import periodic_runs as pr

from .conftest import prose, texts_of


def plain_runs(words, exponent=4, length=6):
    """All maximal stretches of each period; those of a shorter period of the same stretch win."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        for i, equal in enumerate(same):
            if not equal:
                if i + q - start >= max(length, exponent * q):
                    found.setdefault((start, i + q), q)
                start = i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def of(texts, **kw):
    listed, kept = pr._of_texts([t.encode() for t in texts], kw.get("exponent", 4), kw.get("length", 6))
    return [[tuple(r.values()) for r in own] for own in listed.to_pylist()], kept.to_pylist()


def small_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abc"[: rng.randint(1, 3)]
        parts = []
        for _ in range(rng.randint(0, 5)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            parts += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
        yield " ".join(parts)


@pytest.mark.parametrize("exponent,length", [(4, 6), (2, 2), (3, 1), (5, 20)])
def test_equals_plain(exponent, length):
    texts = list(small_texts(exponent, 600)) + ["", " ", "a", "a a", "a b a b"]
    got, kept = of(texts, exponent=exponent, length=length)
    for text, own, rest in zip(texts, got, kept):
        words = text.encode().split()
        want = plain_runs(words, exponent, length)
        assert own == want, text
        assert rest.encode() == plain_collapsed(words, want)


def test_nearest_smaller():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 8, 100, 1025):
        values = np.concatenate(([-1], rng.integers(0, 5, n), [-1]))
        tree, at = pr._Minima(values.copy()), np.arange(1, n + 1)
        least = values[at]
        before = [max(j for j in range(i) if values[j] < values[i]) for i in at]
        after = [min(j for j in range(i + 1, n + 2) if values[j] < values[i]) for i in at]
        assert tree.nearest(at, least, False).tolist() == before
        assert tree.nearest(at, least, True).tolist() == after


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = planted(doc_id, text.encode().split())
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(said.encode()), sha(plain_collapsed(words, runs)))


def test_query_equals_plain(spark, odd_docs, odd_rows):
    extra = [(i, prose(i, 40 + i % 90)) for i in range(100, 400)]
    docs = odd_docs.select("doc_id", "text", "words", "part").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True
    )
    got = [tuple(r) for r in pr.digests(pr.collapse_runs(pr.with_planted_runs(docs))).collect()]
    texts = [(d, t) for d, t in texts_of(odd_rows) if len(t.split()) < 3000]
    want = [plain_row(d, t) for d, t in texts + extra]
    skipped = {d for d, t in texts_of(odd_rows) if len(t.split()) >= 3000}
    assert sorted(map(str, want)) == sorted(str(r) for r in got if r[0] not in skipped)
    assert sum(r[1] > 0 for r in want) > 10


def test_long_texts_take_no_quadratic_time():
    word, n = "w " * 200_000, 200_000
    unit = prose(5, 997).split()
    texts = [word, " ".join(unit * 150), "a b " * 50_000 + "c"]
    began = time.perf_counter()
    got, kept = of(texts)
    assert time.perf_counter() - began < 60
    assert got[0] == [(0, n, 1)] and kept[0] == "w"
    assert (0, 150 * len(unit), len(unit)) in got[1]
    assert got[2] == [(0, 100_000, 2)] and kept[2] == "a b c"


def test_empty_table(no_docs):
    assert pr.digests(pr.collapse_runs(pr.with_planted_runs(no_docs))).count() == 0
