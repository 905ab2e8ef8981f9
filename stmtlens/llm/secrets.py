"""Secret scan: known shapes of keys, and sliding-window entropy over candidate strings.

Candidate strings are long runs of key characters, cut where a name meets its value, without their
allow-listed parts. In each, runs of hex digits and the whole (letters and digits as in base 64) are worked on with the window and
threshold of their class; a string shorter than the window is one window. The Shannon entropy of a
window follows from the counts of its characters, which change by one in and one out as the window
moves. Windows at or above the threshold, merged, are a span. Strings that are allow-listed as a
whole give none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import batch, ids_and_texts

#: The shapes that the contract states.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of at least 24: maximal runs, shorter ones dropped
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")


@dataclass(frozen=True)
class CharClass:
    """Strings of one alphabet, the window slid over them, and the entropy (bits) that is too much."""

    kind: str
    whole: re.Pattern
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", re.compile(r"[0-9a-fA-F]+"), 24, 3.0),
    CharClass("entropy_text", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+"), 20, 3.7),
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
SHORTEST = 20
HEX_RUN = re.compile(r"[0-9a-fA-F]{20,}")
#: Parts of candidates that look random and are none: identifiers, and runs of letters and digits
#: (up to the next separator) that hold a word of test keys.
IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])"
)
TEST_WORD = re.compile("EXAMPLE|example|XXXX|xxxx|0123456789|abcdef0123")
PLAIN_RUN = re.compile("[A-Za-z0-9]+")
#: What stands between a name and its value; at the end of a candidate it is padding.
NAMED = re.compile(r"=+(?=[^=])")
#: Whole strings of that sort: paths, and digits only or only at the end.
ALLOWED = (
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}"),
    re.compile(r"[0-9]+([-_/=+][0-9]+)*"),
)


def high_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged ranges of the windows whose entropy is at least ``bits``."""
    if len(text) < window:
        return []
    # Entropy is log2(w) - sum(n log2 n) / w; the sum changes with two counts per step.
    weight = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, char in enumerate(text):
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            total += weight[n - 1] - weight[n]
            counts[gone] = n - 1
        n = counts.get(char, 0)
        total += weight[n + 1] - weight[n]
        counts[char] = n + 1
        start = i + 1 - window
        if start >= 0 and total <= most:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


Span = tuple[int, int, int]  # start, rank of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed shapes: whole matches, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(
    text: str, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[re.Pattern] = ALLOWED
) -> list[Span]:
    hex_class, text_class = classes
    found = []

    def slide(string: str, at: int, kind: CharClass) -> None:
        if not any(pattern.fullmatch(string) for pattern in allowed):
            rank, window = KINDS.index(kind.kind), min(kind.window, len(string))
            found.extend(
                (at + lo, rank, at + hi) for lo, hi in high_windows(string, window, kind.bits)
            )

    for candidate in CANDIDATE.finditer(text):
        for string, at in _without_parts(candidate.group(), candidate.start()):
            for run in HEX_RUN.finditer(string):
                slide(run.group(), at + run.start(), hex_class)
            if text_class.whole.fullmatch(string) and not hex_class.whole.fullmatch(string):
                slide(string, at, text_class)
    return found


def _allowed_parts(candidate: str) -> list[tuple[int, int]]:
    """Allow-listed parts, in order, and the seams between names and values."""
    found = [m.span() for m in IDENTIFIER.finditer(candidate)]
    if TEST_WORD.search(candidate):
        known = found[:]
        for run in PLAIN_RUN.finditer(candidate):
            while known and known[0][1] <= run.start():
                known.pop(0)
            if (not known or run.end() <= known[0][0]) and TEST_WORD.search(candidate, *run.span()):
                found.append(run.span())
    return sorted(found + [m.span() for m in NAMED.finditer(candidate)])


def _without_parts(candidate: str, at: int) -> Iterator[tuple[str, int]]:
    """What is left of a candidate around its allow-listed parts, with its place, if long enough."""
    start = 0
    for lo, hi in _allowed_parts(candidate):
        if lo - start >= SHORTEST:
            yield candidate[start:lo], at + start
        start = max(start, hi)
    if len(candidate) - start >= SHORTEST:
        yield candidate[start:], at + start


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_spans", pa.string()),
        ("spans", pa.string()),
    ]
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each document: ``doc_id, n_assign, n_access, n_hex, base_spans, spans``.

    One row per input row, also for repeated and null ids; a null text is empty and has no spans.
    ``spans`` holds the base spans and those of the entropy scan, by start and then kind.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            base, every = [], []
            for text in rows["text"].to_pylist():
                own = base_spans(text)
                base.append(own)
                every.append(sorted(own + entropy_spans(text)))
            count = [[sum(kind == k for _, kind, _ in own) for own in base] for k in range(3)]
            yield batch(
                {
                    "doc_id": rows["doc_id"], "n_assign": count[0], "n_access": count[1],
                    "n_hex": count[2], "base_spans": [listed(own) for own in base],
                    "spans": [listed(own) for own in every],
                },
                FOUND,
            )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        find,
        "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string",
    )


def masked_text(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap are one."""
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + entropy_spans(text)):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of each text masked; null texts stay null, other columns as they are."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = rows.schema.get_field_index(text_col)
            new = [None if x is None else masked_text(x, mask) for x in rows.column(at).to_pylist()]
            columns = list(rows.columns)
            columns[at] = pa.array(new, type=rows.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(change, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of scanned documents."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )
