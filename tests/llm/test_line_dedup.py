from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stmtlens.llm import line_dedup as ld
from stmtlens.llm.cuckoo import CuckooFilter, FilterStack

from .conftest import prose, texts_of


def plain(rows, least_docs=3):
    held = defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        for key in set(ld.line_keys(text, ld.Limits())) - {None}:
            held[key].add(("row", n) if doc_id is None else doc_id)
    keeper = {}
    for key, docs in held.items():
        if len(docs) >= least_docs:
            keeper[key] = max((d for d in docs if not isinstance(d, tuple)), default=None)
    found = []
    for doc_id, text in rows:
        lines, keys = text.split("\n"), ld.line_keys(text, ld.Limits())
        kept = [x for x, k in zip(lines, keys) if keeper.get(k) is None or keeper[k] == doc_id]
        found.append((str(doc_id), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_dedup_equals_plain(odd_docs, odd_rows, no_docs):
    want = plain(texts_of(odd_rows))
    assert got(ld.dedup(odd_docs)) == want and sum(x[2] for x in want) >= 3
    assert ld.dedup(no_docs).count() == 0


def test_store_undoes_documents(spark):
    lines = [prose(i, 12).replace("\n", " ") for i in range(12)]
    rows = [(i, "\n".join(lines[(i * k) % 12] for k in range(1, 6))) for i in range(30)]
    schema = "doc_id long, text string"
    first, more = (spark.createDataFrame(x, schema) for x in (rows[:18], rows[18:]))
    gone = spark.createDataFrame([(i,) for i in range(0, 30, 3)], "doc_id long")
    store = ld.delete(ld.insert(ld.build_store(first), more), gone)
    left = [r for r in rows if r[0] % 3]
    docs = spark.createDataFrame(left, schema)
    assert got(ld.rewritten(docs, ld.decisions(store.references))) == plain(left)
    anew = {r["key"] for r in ld.build_store(docs).references.select("key").collect()}
    assert {r["key"] for r in store.references.select("key").collect()} == anew
    filters = [FilterStack.from_bytes(r["cuckoo"]) for r in store.filters.collect()]
    assert sum(int((f.table > 0).sum()) for s in filters for f in s.filters) == len(anew)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=400), st.integers(0, 400))
def test_cuckoo_has_no_false_negatives(values, cut):
    hashes = np.array(values, dtype=np.uint64)
    found = CuckooFilter.holding(hashes)
    assert found.contains(hashes).all() and int((found.table > 0).sum()) == len(hashes)
    found.delete(hashes[:cut])
    assert found.contains(hashes[cut:]).all()
    assert int((found.table > 0).sum()) == len(hashes[cut:])
    again = CuckooFilter.from_bytes(found.to_bytes())
    assert (again.contains(hashes) == found.contains(hashes)).all()


def test_stack_grows_and_shrinks():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    stack = FilterStack.holding(hashes[:50])
    for at in range(50, len(hashes), 450):
        stack.insert(hashes[at : at + 450])
    assert len(stack.filters) > 2 and stack.contains(hashes).all()
    stack = FilterStack.from_bytes(stack.to_bytes())
    stack.delete(hashes[:3000])
    assert stack.contains(hashes[3000:]).all()
    left = sum(int((f.table > 0).sum()) for f in stack.filters)
    assert left == len(hashes) - 3000 and stack.contains(hashes[:3000]).mean() < 0.2


def test_candidates_are_all_repeated_keys():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 40_000, (100_000, 1), dtype=np.uint64) * np.array([[3, 5]], np.uint64)
    maybe = ld._candidates(keys)
    values, n = np.unique(keys[:, 0], return_counts=True)
    assert maybe[np.isin(keys[:, 0], values[n > 1])].all()
