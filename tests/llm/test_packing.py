from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stmtlens.llm import packing

from .conftest import texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("length", [2048, 100])
def test_pieces_cover_every_id_once(odd_docs, odd_rows, length):
    rows = packing.pack(odd_docs, PATH, end_id=1, length=length).collect()
    tokenizer, want = Tokenizer.from_file(PATH), []
    for doc_id, text in texts_of(odd_rows):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc_id, np.array(ids, dtype="<u4").tobytes()))
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    stream, sequences, got, at = b"", defaultdict(int), [], 0
    for r in rows:
        assert sequences[r["sequence_id"]] == r["offset"] and r["length"] * 4 == len(r["ids"])
        sequences[r["sequence_id"]] += r["length"]
        stream += bytes(r["ids"])
        if r["start"] + r["length"] == r["doc_tokens"]:
            got.append((r["doc_id"], stream[at : at + 4 * r["doc_tokens"]]))
            at += 4 * r["doc_tokens"]
    key = lambda x: (x[0] is not None, x)
    assert sorted(got, key=key) == sorted(want, key=key) and at == len(stream)
    full = [sequences[k] for k in sorted(sequences)][:-1]
    assert sorted(sequences) == list(range(len(sequences))) and set(full) <= {length}


def test_crc_edges_and_empty(odd_docs, no_docs):
    stream = packing.placed(packing.encoded(odd_docs, PATH, 1)).persist()
    cut = packing.pieces(stream, 50).collect()
    for r, c in zip(cut, packing.checked(packing.pieces(stream, 50)).collect()):
        assert c["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    edges = packing.boundary_records(stream, 50).collect()
    assert {(r["sequence_id"], r["doc_id"], r["start"]) for r in edges} == {
        (r["sequence_id"], r["doc_id"], r["start"]) for r in cut if r["start"]
    }
    assert packing.pack(no_docs, PATH, 1, 2048).count() == 0
