from __future__ import annotations

import hashlib
import time

import public_tokenizers
import pytest
import sentencepiece

from stmtlens.llm import sentence_pieces as sp

from .conftest import prose, texts_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "  ", "   a  b ", "\n", " \n ", "▁", "▁▁a ▁ b", "x" * 300, "a " * 50, " " * 40,
    "the" + " " * 33 + "the", "日本語 🙂 é ﬁ", "\x00\x01 \t\t x\r\n", "....,,,,!!!??", "e.g. 1,000.5",
    "aaaa bbbb aaaaa", "(foo) \"bar\" 'baz' it's -- ---", "</s> <s> <0x0A> <unk>", "a　b c",
    "m². x², 'tis $-5 %) (a|b) ’, “.", "| a | b |", " .a .  ,b",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equal_to_the_library(library):
    own = sp.Encoder(PATH)
    for text in ODD + [prose(i, 400) for i in range(5)]:
        ids, decoded = own.encode(text)
        want = library.encode(text, add_eos=True)
        assert list(memoryview(ids).cast("i")) == want and decoded == library.decode(want), text


def test_pieces_of_every_piece_and_pair(library):
    """Pieces and neighbours of pieces as words of their own."""
    own = sp.PieceTable(PATH)
    pieces = [p for p in own.halves if sp.BLANK not in p]
    for i in range(0, len(pieces) - 7, 7):
        word = pieces[i] + pieces[(i * 31 + 7) % len(pieces)]
        want = library.encode(word)
        got = [i for part in own.segments(sp.BLANK + word) for i in own.segment_ids(part)]
        assert got == want, word


def test_query_columns(odd_docs, odd_rows, no_docs, library):
    want = []
    for doc_id, text in texts_of(odd_rows):
        ids = library.encode(text, add_eos=True)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in
                  (" ".join(map(str, ids)), library.decode(ids))]
        want.append((str(doc_id), len(ids), *digest))
    got = [(str(r[0]), *r[1:]) for r in sp.digests(sp.encode_decode(odd_docs, PATH)).collect()]
    assert sorted(got) == sorted(want)
    assert sp.encode_decode(no_docs, PATH).count() == 0


def test_long_runs_take_linear_time(library):
    own = sp.Encoder(PATH)
    million = 1_000_000
    began = time.perf_counter()
    found = [own.encode(text) for text in (" " * million, "a" * million, "a b" + " " * million + "c", "0f" * (million // 2))]
    assert time.perf_counter() - began < 60
    for text, (ids, decoded) in zip((" " * million, "a b" + " " * million + "c"), (found[0], found[2])):
        want = library.encode(text, add_eos=True)
        assert list(memoryview(ids).cast("i")) == want and decoded == library.decode(want)


def test_blank_runs_equal_the_library(library):
    own = sp.Encoder(PATH)
    for n in range(1, 140):
        for text in (" " * n, "a" + " " * n + "b", " " * n + "."):
            want = library.encode(text, add_eos=True)
            assert list(memoryview(own.encode(text)[0]).cast("i")) == want, (n, text)
