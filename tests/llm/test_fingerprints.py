from __future__ import annotations

import hashlib

import pandas as pd
import xxhash
from stmtlens.llm import fingerprints as fp

from .conftest import prose, texts_of


def slow_cuts(text: bytes, sizes=fp.Sizes()):
    """One byte after the other, with the hash written out."""
    ends, at = [], 0
    for i in range(len(text)):
        size = i + 1 - at
        if size < sizes.smallest or i + 1 == len(text):
            continue
        h = sum(int(fp.GEAR[text[i - k]]) << k for k in range(min(i + 1, 32))) % (1 << 32)
        bits = sizes.bits + 2 if size <= sizes.normal else sizes.bits - 2
        if h >> (32 - bits) == 0 or size == sizes.largest:
            ends.append(i + 1)
            at = i + 1
    return ends + [len(text)] * bool(text)


def test_cuts_equal_byte_by_byte():
    texts = [prose(i, 150 * i).encode() for i in range(6)] + [b"", b"a" * 2000, b"short"]
    assert fp.cuts(texts) == [slow_cuts(x) for x in texts]


def test_shifted_text_keeps_its_chunks():
    text = prose(3, 900)
    a, b = fp.chunk_sets([text.encode(), ("Inserted. " + text).encode()])
    assert fp.containment(a, b) > 0.85 and fp.containment(a, a) == 1.0


def turn(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed=42) >> (64 - fp.TURN_BITS)


def plain_rows(rows):
    """Every row with the next one, by brute force."""
    rows = sorted(rows, key=lambda r: (-(fp.NO_ID if r[0] is None else r[0]), turn(r[1]), r[1]))
    for i, (doc_id, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        new = fp.edited(text, other)
        a, b, c = fp.chunk_sets([x.encode() for x in (text, new, other)])
        yield (
            str(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(), fp.written_out(a),
            fp.written_out(b), fp.containment(a, b), fp.containment(a, c),
        )


def test_rows_equal_plain(odd_docs, odd_rows, no_docs):
    got = [(str(r[0]), *r[1:]) for r in fp.with_neighbours(odd_docs).collect()]
    assert sorted(got) == sorted(plain_rows(texts_of(odd_rows)))
    assert fp.with_neighbours(no_docs).count() == 0


def test_hot_ids_are_cut_and_keep_their_order(spark):
    ids = [None] * 150 + [7] * 200 + [9] * 100 + list(range(150))
    rows = [(doc_id, prose(k, 20)) for k, doc_id in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r[0]), *r[1:]) for r in fp.with_neighbours(docs).collect()]
    assert sorted(got) == sorted(plain_rows(rows))


def test_part_numbers_cut_hot_keys_and_fall_with_the_key():
    part = fp._part_of([3, 5, 5, 5, 9]).func
    keys = pd.Series([10, 9, 8, 6, 5, 5, 5, 4, 3, 2])
    turns = pd.Series([0, 9, 1, 2, 0, 1 << 30, (1 << 31) - 1, 3, 3, 1])
    assert part(keys, turns).tolist() == [0, 0, 1, 1, 2, 3, 4, 5, 5, 6]


def test_one_document_follows_itself(spark):
    one = spark.createDataFrame([(1, "ab" * 100)], "doc_id long, text string")
    row = fp.with_neighbours(one).first()
    assert row["near_next"] == row["near_edited"] == 1.0
