from __future__ import annotations

import numpy as np
import pytest

from stmtlens.llm import superkmers as sk

from .conftest import prose, texts_of


def plain(rows, size):
    owner = {}
    for doc_id, text in rows:
        words = text.encode().split()
        for i in range(len(words) - size + 1 if doc_id is not None else 0):
            key = tuple(words[i : i + size])
            owner[key] = min(owner.get(key, doc_id), doc_id)
    found = []
    for doc_id, text in rows:
        words = text.encode().split()
        gone = set()
        for i in range(len(words) - size + 1 if doc_id is not None else 0):
            if owner[tuple(words[i : i + size])] < doc_id:
                gone |= set(range(i, i + size))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        found.append((str(doc_id), len(words), len(gone), kept))
    return sorted(found)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("size", [13, 3, 4])
def test_equal_to_plain(odd_docs, odd_rows, size):
    want = plain(texts_of(odd_rows), size)
    assert got(sk.drop_repeats(odd_docs, size)) == want and sum(r[2] for r in want) > 40


def test_empty(no_docs):
    assert sk.drop_repeats(no_docs).count() == 0


def test_equal_windows_share_a_minimiser():
    text = prose(1, 200)
    words = sk.Words.of([text, "lead in " + text + " tail"])
    found, seen = sk.super_kmers(words, 13), {}
    flat = words.data.split(b" ")
    for lo, hi, m in zip(found.lo, found.hi, found.minimiser):
        for i in range(lo, hi + 1):
            assert seen.setdefault(tuple(flat[i : i + 13]), m) == m
    assert sum(found.hi - found.lo + 1) == sum(np.diff(words.first) - 12)


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(sk, "_mixed", lambda h: h * np.uint64(0))
    ids = np.array([1, 2, 3, 1, 2, 3, 2, 2], dtype=np.int32)
    order, groups = sk._exact_order(ids, np.arange(6), 3)
    names = [tuple(ids[i : i + 3]) for i in order]
    assert len(groups) == len(set(names)) and names == sorted(names, key=lambda x: x[::-1])
