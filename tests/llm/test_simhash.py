from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from stmtlens.llm import graph
from stmtlens.llm import simhash as sh

from .conftest import texts_of


def plain_print(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints):
    """Prints to the smallest print reachable, comparing all with all."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in values}


def test_components_equal_plain(odd_docs, odd_rows, no_docs):
    rows = [(doc_id, plain_print(text)) for doc_id, text in texts_of(odd_rows)]
    root, least = plain_roots([p for _, p in rows]), {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[root[p]] = min(least.get(root[p], doc_id), doc_id)
    want = [(str(d), f"{p:016x}", str(least.get(root[p]))) for d, p in rows]
    got = [
        (str(r[0]), r[1], str(r[2]))
        for r in sh.components(odd_docs)
        .select("doc_id", sh.hex_digits(sh.F.col("fp")), "component_id").collect()
    ]
    assert sorted(got) == sorted(want)
    assert sh.components(no_docs).count() == 0


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    made = base[rng.integers(0, 4, n)]
    for _ in range(3):
        flip = np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        made = np.where(rng.random(n) < 0.7, made ^ flip, made)
    return np.unique(np.concatenate((made, rng.integers(0, 2**64, n, dtype=np.uint64))))


@pytest.mark.parametrize("pairwise", [1 << 13, 3])
def test_links_connect_all_near_prints(spark, monkeypatch, pairwise):
    monkeypatch.setattr(sh, "PAIRWISE", pairwise)
    prints = clustered(pairwise, 400)
    # In one process, so that the patched limit holds.
    a, b = [], []
    for mask in sh.bucket_masks():
        key = prints & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        run = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        member, root = sh.bucket_links(prints[order], run)
        a.append(order[member])
        b.append(order[root])
    got = graph.local_roots(len(prints), np.concatenate(a), np.concatenate(b))
    want = plain_roots([int(p) for p in prints])
    for i, p in enumerate(prints):
        assert int(prints[got[i]]) == want[int(p)]


@pytest.mark.parametrize("pairwise, neighbours", [(1 << 13, 1 << 22), (3, 1 << 22), (3, 100)])
def test_links_of_a_wider_limit(monkeypatch, pairwise, neighbours):
    monkeypatch.setattr(sh, "PAIRWISE", pairwise)
    monkeypatch.setattr(sh, "NEIGHBOURS", neighbours)
    rng = np.random.default_rng(neighbours)
    prints = clustered(pairwise, 300)
    flips = [sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in prints]
    prints = np.unique(np.concatenate((prints, prints ^ np.array(flips, dtype=np.uint64))))
    masks = sh.bucket_masks(4)
    assert len(masks) == 15 and np.bitwise_or.reduce(np.array(masks, dtype=np.uint64)) == 2**64 - 1
    a, b = [], []
    for mask in masks:
        key = prints & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        run = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        member, root = sh.bucket_links(prints[order], run, 4)
        a.append(order[member])
        b.append(order[root])
    got = graph.local_roots(len(prints), np.concatenate(a), np.concatenate(b))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = graph.local_roots(len(prints), *np.nonzero(near))
    assert (got == want).all() and 1 < len(np.unique(want)) < len(prints)


def test_roots_of_long_paths(spark):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(40)] + [(-5, 200)]
    path += [(int(a), int(b)) for a, b in rng.integers(300, 340, (30, 2))]
    links = spark.createDataFrame(path, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.roots(links).collect()}
    nodes = sorted({x for pair in path for x in pair if pair[0] != pair[1]})
    number = {x: i for i, x in enumerate(nodes)}
    live = [(a, b) for a, b in path if a != b]
    root = graph.local_roots(
        len(nodes), np.array([number[a] for a, _ in live]), np.array([number[b] for _, b in live])
    )
    assert got == {x: nodes[root[number[x]]] for x in nodes}
