"""The pipeline's stages against plain code, each on its own input."""

from __future__ import annotations

import unicodedata
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from stmtlens.llm import secrets

from .test_line_dedup import plain as plain_lines
from .test_quality import plain as plain_measures
from .test_shingle_join import plain_roots, plain_set

FOLDER = "/root/testdata/sf0.001"


def accepted(text):
    n, chars, symbols, repeated_lines, repeated = plain_measures(text)
    lettered = sum(any(unicodedata.category(c)[0] == "L" for c in w) for w in text.split())
    return not (
        n < 50 or 100 * repeated > 50 * n or 4 * symbols > n
        or 2 * repeated_lines > text.count("\n") + 1 or chars < 2 * n or chars > 20 * n
        or 2 * lettered < n
    )


def stages(spark, docs):
    found = [docs]
    for _, stage in pipeline.STAGES:
        found.append(stage(spark, found[-1], FOLDER).persist())
    return found


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def check_stages(inputs):
    first, good, lines, single, masked, packed = inputs
    for df in inputs[1:-1]:
        assert df.columns == list(pipeline.COLUMNS)
    text = lambda rows: sorted(rows, key=str)
    assert text(pairs(good)) == text(r for r in pairs(first) if accepted(r[1]))

    want = [(d, t) for d, _, _, t in plain_lines(pairs(good)) if t.split()]
    assert text(want) == text((str(d), t) for d, t in pairs(lines))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    rows = sorted((r for r in pairs(lines) if r[0] is not None), key=str)
    roots, least = plain_roots([plain_set(t) for _, t in rows]), {}
    for (doc_id, _), root in zip(rows, roots):
        least[root] = min(least.get(root, doc_id), doc_id)
    kept = [d for d, _ in pairs(single)]
    assert sorted(d for d in kept if d is not None) == sorted(least.values())
    assert kept.count(None) == sum(d is None for d, _ in pairs(lines))

    assert text(pairs(masked)) == text((d, secrets.masked_text(t)) for d, t in pairs(single))
    pieces = packed.collect()
    filled = Counter()
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(kept)
    assert set(list(dict(sorted(filled.items())).values())[:-1]) <= {2048}


@pytest.fixture(scope="module")
def sample(spark):
    return stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_stages(sample):
    check_stages(sample)
    assert 0 < sample[4].count() < sample[0].count()


def test_run_is_the_stages(spark, sample):
    """Up to the order in which documents are packed."""
    tokens = lambda df: Counter({r["doc_id"]: r["doc_tokens"] for r in df.collect()})
    assert tokens(pipeline.run(spark, FOLDER)) == tokens(sample[-1])


def test_odd_documents(spark, odd_docs):
    found = stages(spark, odd_docs)
    check_stages(found)
    assert found[4].count() >= 5


def test_empty_table(spark, no_docs):
    assert all(df.count() == 0 for df in stages(spark, no_docs))
