from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stmtlens.llm import language

from .conftest import texts_of


def plain_trees(rows, depth):
    trees = defaultdict(lambda: defaultdict(Counter))
    for lang, text in rows:
        data = b"\0" * depth + text.encode()
        for i in range(depth, len(data)):
            for order in range(depth + 1):
                trees[lang][data[i - order : i]][data[i]] += 1
    return trees


def plain_length(tree, text, depth):
    data, bits = b"\0" * depth + text.encode(), 0.0
    for i in range(depth, len(data)):
        for order in range(depth, -1, -1):
            seen = tree.get(data[i - order : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain(odd_docs, odd_rows):
    model = language.train(odd_docs, depth=2, share_bits=60)
    rows = [(r[2], r[1]) for r in odd_rows if r[1] is not None and r[2] is not None]
    trees = plain_trees(rows, 2)
    assert set(model.languages) == set(trees)
    texts = [text for _, text in texts_of(odd_rows)]
    got = language.code_lengths(model, [text.encode() for text in texts])
    for text, row in zip(texts, got):
        for lang, bits in zip(model.languages, row):
            assert bits == pytest.approx(plain_length(trees[lang], text, 2), abs=1e-6)


def test_predictions(odd_docs, odd_rows, no_docs):
    rows = language.held_out_predictions(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    letters = {str(d): any(c.isalpha() for c in text) for d, text in texts_of(odd_rows)}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert (r["lang_pred"] == "und") == (not letters[str(r["doc_id"])])
        assert 0 <= r["score"] <= 1
    assert language.held_out_predictions(no_docs).count() == 0
    unknown = language.predict(odd_docs, language.train(no_docs))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id")
    out = found.where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98


def test_a_language_of_a_few_bytes_is_learned_whole(spark):
    """Among a large language whose rare contexts are pruned."""
    common = " ".join(f"word{i % 50} the of and" for i in range(30_000))
    rows = [(common, "en"), ("qz", "xx"), ("zq qz", "xx"), ("qzzq", "xx")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language.train(docs, share_bits=10)
    assert model.languages == ("en", "xx")
    trees = plain_trees([(lang, text) for text, lang in rows], 3)
    for text in ("qz zq", "zqqz", "the word"):
        got = language.code_lengths(model, [text.encode()])[0][1]
        assert got == pytest.approx(plain_length(trees["xx"], text, 3), abs=1e-6)
    asked = spark.createDataFrame([(1, "qz qz"), (2, "the word")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, model).collect()}
    assert found == {1: "xx", 2: "en"}
    kept = [len(order.codes) for order in model.orders["en"]]
    assert kept[3] < len(plain_trees([("en", common)], 3)["en"])
