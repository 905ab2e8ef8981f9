from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stmtlens.llm import contexts, ctw

from .conftest import prose, texts_of


def log_kt(a, b):
    return (
        math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    )


def plain_tree(texts, depth):
    """Counts of every node: (prefix, bytes before) to [zeros, ones]."""
    counts = defaultdict(lambda: [0, 0])
    for text in texts:
        data = b"\0" * depth + text + b"\xff"
        for i in range(depth, len(data)):
            for place in range(8):
                prefix = (1 << place) + (data[i] >> (8 - place))
                for order in range(depth + 1):
                    counts[prefix, data[i - order : i]][data[i] >> (7 - place) & 1] += 1
    return counts


def log_weighted(counts, children, node, depth):
    """Log probability that the training text has at a node, straight from the definition."""
    own = log_kt(*counts[node])
    if len(node[1]) == depth:
        return own
    below = sum(log_weighted(counts, children, child, depth) for child in children[node])
    return math.log(0.5) + np.logaddexp(own, below)


def block_probability(counts, depth, prefix):
    children = defaultdict(list)
    for p, context in counts:
        if p == prefix and context:
            children[p, context[1:]].append((p, context))
    return log_weighted(counts, children, (prefix, b""), depth)


def log_probability_of(texts, codes, depth):
    """Of the byte of each code, after training on texts."""
    seen, counts = np.unique(contexts.codes(texts, depth, b"\xff")[0], return_counts=True)
    every = np.union1d(seen, codes)
    learned = np.zeros(len(every), dtype=np.int64)
    learned[np.searchsorted(every, seen)] = counts
    return ctw.tree_log_probabilities(every, learned, depth)[np.searchsorted(every, codes)]


def test_next_byte_is_the_ratio_of_block_probabilities():
    texts = [prose(i, 40).encode() for i in range(3)]
    texts = [b" ".join(t.lower().split()) for t in texts]
    depth = 2
    seen = [b"\0\0" + t for t in texts]
    for context, byte in [(t[i : i + 2], t[i + 2]) for t in seen for i in (0, 5, 11, 40)]:
        want = 0.0
        for place in range(8):
            prefix = (1 << place) + (byte >> (8 - place))
            counts = plain_tree(texts, depth)
            before = block_probability(counts, depth, prefix)
            for order in range(depth + 1):
                counts[prefix, context[depth - order :]][byte >> (7 - place) & 1] += 1
            want += block_probability(counts, depth, prefix) - before
        code = np.array([int.from_bytes(context + bytes([byte]), "big")], dtype=np.uint64)
        got = log_probability_of(texts, code, depth)[0] * math.log(10)
        assert got == pytest.approx(want, abs=1e-6)


def test_probabilities_sum_to_one():
    texts = [ctw.normal_form(prose(i, 300)) for i in range(4)]
    for texts in (texts, []):
        for context in (b"the", b"\0\0a", b"qqq"):
            codes = np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(context, "big") << 8)
            assert (10 ** log_probability_of(texts, codes, 3)).sum() == pytest.approx(1, abs=1e-9)


def test_log_gamma(spark):
    row = [0.5, 1.0, 1.5, 7.5, 1e3, 1e9, 3e12]
    df = spark.createDataFrame([(x,) for x in row], "x double")
    want = pytest.approx([math.lgamma(x) for x in row], rel=1e-9, abs=1e-8)
    assert [r[0] for r in df.select(ctw._log_gamma(ctw.F.col("x"), ctw.F.log)).collect()] == want
    assert list(ctw._log_gamma(np.array(row), np.log)) == want


def test_codes():
    found, sizes = contexts.codes([b"ab", b"", b"c"], 2, b"\xff")
    want = [b"\0\0a", b"\0ab", b"ab\xff", b"\0\0\xff", b"\0\0c", b"\0c\xff"]
    assert [int(x).to_bytes(3, "big") for x in found] == want and list(sizes) == [3, 1, 2]


def test_base_line_equals_plain(odd_docs, odd_rows, no_docs):
    rows = texts_of(odd_rows)
    out = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    split = [text.encode().lower().split() + [b" end"] for _, text in rows]
    counts = Counter(w for words, o in zip(split, out) if not o for w in words)
    n, v = sum(counts.values()), len(counts)
    want = [
        (str(d), o, len(words), sum(w in counts for w in words), n,
         sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        for (d, _), o, words in zip(rows, out, split)
    ]
    got = ctw.held_out_scores(odd_docs).collect()
    key = lambda r: (r[0], r[2], r[3], round(r[5], 6))
    for g, w in zip(sorted([(str(r[0]), *r[1:]) for r in got], key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] < 0
    assert ctw.held_out_scores(no_docs).count() == 0


def test_model_beats_the_base_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    row = ctw.held_out_scores(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)")
    score, base = row.first()
    assert score > base


@pytest.mark.parametrize("top", [1, 3, 5])
def test_scores_use_every_trained_node(spark, monkeypatch, top):
    """Words of one document each are a tiny share of the whole."""
    monkeypatch.setattr(ctw, "TOP", top)
    rows = [(i, prose(i, 60) + f" rare{i}word q{i}z") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [ctw.normal_form(text) for _, text in rows]
    found, sizes = contexts.codes(texts, 5, contexts.END)
    codes, back = np.unique(found, return_inverse=True)
    logs = log_probability_of([t for t, o in zip(texts, out) if not o], codes, 5)
    want = dict(zip(range(40), contexts.per_text(logs[back], sizes)))
    got = {r["doc_id"]: r["score"] for r in ctw.held_out_scores(docs).collect()}
    assert got == pytest.approx(want, rel=1e-6)
