"""Encoding by a SentencePiece BPE model without merging: a table of last tokens per prefix.

For every prefix of a word the encoding ends in one certain token. An automaton over the pieces
gives the tokens that end at each place; the right one is that which stands next to the last token
of the prefix before it, that is, with no merge across their seam. The ids follow backwards from the
end. Whether two pieces stand next to each other is found from the merges that formed them.

Words are independent: no piece runs on across a blank. Runs of blanks are pieces of equal score,
merged from the left after all else; they are worked out by themselves.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import chunks, ids_and_texts

BLANK = "▁"
MARKS = ".,;:!?()|\"'-"
CACHED_WORDS = 1 << 19
CACHED_PAIRS = 1 << 20
CHUNK_BYTES = 4 << 20
_NEVER = 1 << 60


class PieceTable:
    """A model's pieces: the order of their merges, the two halves of each, and the automaton."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.byte_id = {
            int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)
        }
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = special
        usable = [
            i for i in range(size)
            if i not in special and i not in self.byte_of and not model.is_unused(i)
        ]
        self.id_of = {self.pieces[i]: i for i in usable}
        self.runs = {p: i for p, i in self.id_of.items() if set(p) == {BLANK}}
        scores = sorted(
            (-model.get_score(i), i) for p, i in self.id_of.items()
            if len(p) > 1 and p not in self.runs
        )
        if len({score for score, _ in scores}) != len(scores):
            raise ValueError("pieces of equal score: the order of merges is not known from the model")
        if any(BLANK in p[1:] for p in self.id_of if p not in self.runs):
            raise ValueError("a piece runs on across a blank")
        #: When a piece is formed: the rank of its merge, -1 for single characters.
        self.formed = {self.pieces[i]: rank for rank, (_, i) in enumerate(scores)}
        self.halves: dict[str, tuple[str, str]] = {}
        #: Whether two pieces stand next to each other, by both ids in one number.
        self.stands: dict[int, bool] = {}
        reachable = [p for p in self.formed if self._split(p)]
        self.automaton = ahocorasick.Automaton()
        for piece in reachable + [p for p in self.id_of if len(p) == 1]:
            self.automaton.add_word(piece, (self.id_of[piece], len(piece)))
        self.automaton.make_automaton()
        # Inside pieces these marks never follow other characters but for a few pairs, so a word
        # can be cut before one; texts with such a pair are cut at blanks only.
        inner = {p[k : k + 2] for p in reachable for k in range(len(p) - 1)}
        self.joined = {x for x in inner if x[1] in MARKS and x[0] not in MARKS + BLANK}
        own = re.escape(MARKS)
        before = re.escape("".join(sorted({x[0] for x in self.joined})))
        self.seams = re.compile(f"[{before}][{own}]" if before else "(?!)")
        self.at_marks = re.compile(
            f"{BLANK}+(?:[{own}][^{BLANK}\n]*|[^{BLANK}\n{own}]*)"
            f"|[{own}][^{BLANK}\n]*|\n|[^{BLANK}\n{own}]+"
        )
        self.at_blanks = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")

    def segments(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses."""
        whole = any(seam in self.joined for seam in self.seams.findall(text))
        return (self.at_blanks if whole else self.at_marks).findall(text)

    def _split(self, piece: str) -> bool:
        """Form a piece by merges and note its last two halves; False if it comes out otherwise."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.formed.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == _NEVER:
                return False
            if len(parts) == 2:
                left, right = parts
                whole = self.formed[piece]
                if whole < max(self.formed.get(left, -1), self.formed.get(right, -1)):
                    raise ValueError(f"piece {piece!r} is formed before one of its halves")
                self.halves[piece] = (left, right)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def stand(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart when their characters are merged together.

        Seen backwards in time, the seam had the same two neighbours since the later of the two was
        formed. A merge of these would have come first if it ranks below that formation. Of two
        formations of one rank the left one came first, and so did a merge at the seam before an
        equal one to its right.
        """
        a, b, until = left, right, _NEVER
        formed, halves = self.formed, self.halves
        while True:
            if formed.get(a + b, _NEVER) < until:
                return False
            when_a, when_b = formed.get(a, -1), formed.get(b, -1)
            if when_a > when_b:
                until, a = when_a, halves[a][1]
            elif when_b >= 0:
                until, b = when_b + 1, halves[b][0]
            else:
                return True

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word, by the last piece of each prefix; unknown characters become bytes."""
        n, stands = len(word), self.stands
        last = [-1] * n
        for end, (piece, size) in self.automaton.iter(word):
            if last[end] >= 0:
                continue
            before = last[end - size] if size <= end else -1
            if before < 0:
                # At the start, or behind an unknown character: nothing can merge across.
                last[end] = piece
                continue
            seam = before << 32 | piece
            apart = stands.get(seam)
            if apart is None:
                if len(stands) > CACHED_PAIRS:
                    stands.clear()
                apart = stands[seam] = self.stand(self.pieces[before], self.pieces[piece])
            if apart:
                last[end] = piece
        found, end = [], n - 1
        while end >= 0:
            piece = last[end]
            if piece >= 0:
                found.append(piece)
                end -= len(self.pieces[piece])
            else:
                found += [self.byte_id[b] for b in reversed(word[end].encode())]
                end -= 1
        found.reverse()
        return found

    def run_pieces(self, n: int) -> list[str]:
        """Pieces of ``n`` blanks: equal scores, so the leftmost pair with a piece merges first.

        Left of the next blank no pair is open, so only the last part can merge with it, and what
        comes of that with the part before.
        """
        sizes = {len(run) for run in self.runs}
        parts: list[int] = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in sizes:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [BLANK * size for size in parts]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of blanks and a word behind them. The last blank may be part of the word's pieces;
        the others are a run, with it if it stays alone."""
        if segment[:2] != BLANK * 2 and segment != BLANK:
            return self.word_ids(segment)
        word = segment.lstrip(BLANK)
        blanks = len(segment) - len(word)
        ids = self.word_ids(BLANK + word)
        if ids[0] == self.id_of[BLANK]:
            ids = ids[1:]
        else:
            blanks -= 1
        return [self.id_of[piece] for piece in self.run_pieces(blanks)] + ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their marks, bytes put together, control ids silent."""
        if self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(BLANK, " ")
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(BLANK, " ")


class Encoder:
    """Ids and decoded text of whole texts; each distinct word is worked out once per worker."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.end = np.array([self.table.end_id], dtype=np.int32).tobytes()

    def _word(self, segment: str) -> tuple[bytes, str]:
        ids = self.table.segment_ids(segment)
        return array("i", ids).tobytes(), self.table.decode(ids)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (32-bit numbers) with the end id, and the text that they decode to."""
        if not text:
            return self.end, ""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        segments = self.table.segments(BLANK + text.replace(" ", BLANK))
        known = self.known
        for segment in set(segments).difference(known):
            known[segment] = self._word(segment)
        found = [known[segment] for segment in segments]
        decoded = "".join([word for _, word in found])
        # The blank before the first word is the encoder's own.
        return b"".join([ids for ids, _ in found]) + self.end, decoded[1:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_CODED = pa.schema(
    [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
)


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids, decoded``: each text's ids with the end id, and what they decode to.

    One row per input row, also for null and repeated ids; a null text is empty and has the end id
    alone. An empty table gives no rows.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for rows in batches:
            texts = rows["text"].to_pylist()
            for lo, hi in chunks(texts, CHUNK_BYTES):
                found = [own.encode(text) for text in texts[lo:hi]]
                values = np.frombuffer(b"".join([ids for ids, _ in found]), dtype=np.int32)
                sizes = [0] + [len(ids) // 4 for ids, _ in found]
                offsets = pa.array(np.cumsum(sizes).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"].slice(lo, hi - lo),
                        pa.ListArray.from_arrays(offsets, pa.array(values)),
                        pa.array([text for _, text in found], type=pa.string()),
                    ],
                    schema=_CODED,
                )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        code, "doc_id long, ids array<int>, decoded string"
    )


def digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
