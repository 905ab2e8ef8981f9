"""Tensored banding against all pairs of sets."""

from __future__ import annotations

import random

import numpy as np
from stmtlens.llm import tensor_minhash as tm

from .conftest import prose, texts_of
from .test_shingle_join import edited, families, plain_set


def plain_roots(sets, percent=85):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def chain(f):
    """Each text near the one before it, the ends far apart; and texts just outside of all."""
    texts = [prose(f, 260)]
    for k in range(14):
        texts.append(edited(texts[-1], 3, 50 * f + k))
    return texts + [edited(texts[0], 6, 900 + f), edited(texts[7], 5, 901 + f)]


def test_components_equal_plain(spark, percent=85):
    texts = families() + [t for f in range(30, 36) for t in chain(f)]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [plain_set(t) for t in texts]
    want = plain_roots(sets, percent)
    got = {r["doc_id"]: r for r in tm.components(docs, percent=percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert 20 < len(set(want)) < len(texts) - 30


def graded(f, n):
    """Copies of one text with more and more changes: the first are linked through it alone."""
    base = prose(f, 150)
    return [base] + [edited(base, 1 + k % 8, 1000 * f + k) for k in range(n)]


def test_one_large_family(spark):
    texts = graded(40, 160) + chain(41)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in tm.components(docs).collect()}
    want = plain_roots([plain_set(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    assert 20 < len(set(want)) < 160


def test_near_pivot_finds_all(spark, monkeypatch):
    """Without links by stars all are left to the last stage."""
    texts = [t for f in range(4) for t in chain(f)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = tm._may_be_alike
    calls = []

    def none_at_first(percent):
        calls.append(percent)
        return real(percent) & tm.F.lit(len(calls) > 1)

    monkeypatch.setattr(tm, "_may_be_alike", none_at_first)
    got = {r["doc_id"]: r["component_id"] for r in tm.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_roots([plain_set(t) for t in texts])
    assert len(calls) == 2


def test_half_keys_follow_similarity():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(300):
        both, a, b = rng.integers(0, 1 << 63, (3, 850), dtype=np.uint64)
        one, two = (np.concatenate((both, x[:75])) for x in (a, b))
        agree.append((tm.half_keys(one) == tm.half_keys(two)).mean())
    assert abs(np.mean(agree) - 0.85**2) < 0.02
    agree = np.array(agree)
    assert tm.half_keys(one).shape == (2 * tm.HALF_KEYS,)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    texts = texts_of(odd_rows)
    sets = [plain_set(text) for _, text in texts]
    root, least = plain_roots(sets), {}
    for (doc_id, _), r in zip(texts, root):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = []
    for (doc_id, _), own, r in zip(texts, sets, root):
        component = least.get(r)
        want.append((doc_id, len(own), component, doc_id == component))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in tm.components(odd_docs).collect())
    assert tm.components(no_docs).count() == 0
