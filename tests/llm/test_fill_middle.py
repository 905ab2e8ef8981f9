"""Fill-in-the-middle against plain code, and back to the exact text."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from stmtlens.llm import fill_middle as fim

from .conftest import texts_of


def plain(doc_id, text, seed=7, rate=100, spm=50):
    said = f"{seed}:{'' if doc_id is None else doc_id}"
    digits = hashlib.sha256(said.encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = ["a <P> b\nc", "<S>", "x<M>", "<P", ">\nS>", "<\nS>\n<", "<<S\n", "P>\n<S<", "é\n<\nü🙂\n\n<P\nx"]


@pytest.fixture(scope="module")
def more(spark, odd_docs):
    extra = [(1000 + i, text) for i, text in enumerate(MARKED * 12)]
    return odd_docs.select("doc_id", "text", "block", "key").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True
    ), extra


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (90, 100)])
def test_equals_plain_and_round_trip(more, odd_rows, rate, spm):
    docs, extra = more
    made = fim.restore(fim.transform(docs, rate=rate, spm_rate=spm)).collect()
    want = [plain(d, t, rate=rate, spm=spm) for d, t in texts_of(odd_rows) + extra]
    text_of = {row: text for row, (_, text) in zip(want, texts_of(odd_rows) + extra)}
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(r["restored"] == text_of[tuple(r)[:6]] for r in made)


def test_small_windows(monkeypatch, more, odd_rows):
    monkeypatch.setattr(fim, "WINDOW", 7)
    texts = [t for _, t in texts_of(odd_rows) if len(t) < 4000] + MARKED
    data, first = fim._joined([t.encode() for t in texts])
    draws = np.random.default_rng(1).integers(0, 1 << 32, (len(texts), 2))
    n, one, two = fim.line_cuts(data, first, draws)
    form = np.array([0 if not t or re.search("<[PSM]>", t) else 1 + i % 2 for i, t in enumerate(texts)])
    out, bounds = fim.scattered(data, first, one, two, form)
    text, back = fim.gathered(out, bounds, form)
    assert bytes(text) == bytes(data) and (back == first).all()
    prefix, middle = fim._code_points(data, first, one, two)
    assert prefix.tolist() == [len(bytes(data[a:b]).decode()) for a, b in zip(first, one)]
    assert middle.tolist() == [len(bytes(data[a:b]).decode()) for a, b in zip(one, two)]


def test_empty_table(no_docs):
    assert fim.digests(fim.restore(fim.transform(no_docs))).count() == 0
