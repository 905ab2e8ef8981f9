"""Fill-in-the-middle transformation by displacement scatter.

The documents of a batch lie one after the other in one byte array. A scan for line ends gives the
units, the units give the cuts. Each piece of a text (prefix, middle, suffix) is displaced by one
distance, from its place in the batch to its place in the output; a difference array holds the
change of that distance at the first byte of each piece, so its running sum is every byte's output
shift, and one scatter writes all outputs. The three markers fill the gaps.

Restoring is the inverse: the markers found in the outputs say where each piece went, the difference
array then holds the way back, and one gather rebuilds all texts from outputs and forms alone.

Both directions work on windows of the batch and carry the running sum along, so that the index
arrays stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import batch, chunks

PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3  # bytes of a marker
CHUNK_BYTES = 4 << 20
WINDOW = 1 << 20


def _windows(changes_at: np.ndarray, changes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Running sums of a sparse difference array over ``n`` places, a window at a time.

    ``changes_at`` is sorted; several changes at one place add up.
    """
    carried = 0
    for lo in range(0, n, WINDOW):
        hi = min(lo + WINDOW, n)
        some = slice(*np.searchsorted(changes_at, (lo, hi)))
        sums = np.zeros(hi - lo, dtype=np.int64)
        np.add.at(sums, changes_at[some] - lo, changes[some])
        if hi > lo:
            sums[0] += carried
            np.cumsum(sums, out=sums)
            carried = int(sums[-1])
        yield lo, sums


def _shifts(starts: np.ndarray, sizes: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference array of pieces that lie one after the other: place and change of the shift."""
    some = np.flatnonzero(sizes)
    return starts[some], np.diff(shift[some], prepend=0)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), _bounds(sizes)


def _marks(data: np.ndarray, letter: bytes) -> np.ndarray:
    """Places where a marker starts."""
    if len(data) < MARK:
        return np.zeros(0, dtype=np.int64)
    hit = (data[:-2] == letter[0]) & (data[1:-1] == letter[1]) & (data[2:] == letter[2])
    return np.flatnonzero(hit)


def line_cuts(
    data: np.ndarray, first: np.ndarray, draws: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and the places of its two cuts, from two draws per text.

    A line ends behind its line feed; what follows the last one is a line too.
    """
    ends = np.flatnonzero(data == 10) + 1
    lo, hi = np.searchsorted(ends, first[:-1], "right"), np.searchsorted(ends, first[1:], "right")
    last = np.zeros(len(lo), dtype=np.int64)
    some = hi > lo
    last[some] = ends[hi[some] - 1]
    open_line = (first[1:] > first[:-1]) & (last < first[1:])
    n = hi - lo + open_line
    units = np.sort(draws % (n + 1)[:, None], axis=1)

    def place(k: np.ndarray) -> np.ndarray:
        at = np.where(k == n, first[1:], first[:-1])
        inner = (k > 0) & (k < n)
        at[inner] = ends[lo[inner] + k[inner] - 1]
        return at

    return n, place(units[:, 0]), place(units[:, 1])


def scattered(
    data: np.ndarray, first: np.ndarray, one: np.ndarray, two: np.ndarray, form: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all texts, one after the other, and their bounds. ``form``: 0 plain, 1 psm, 2 spm."""
    sizes = np.diff(first)
    moved = form > 0
    bounds = _bounds(sizes + 3 * MARK * moved)
    out = np.empty(bounds[-1], dtype=np.uint8)
    start, end, base = first[:-1], first[1:], bounds[:-1]
    prefix, middle, suffix = one - start, two - one, end - two
    # Where the three pieces of each text go; a plain text moves as a whole.
    to_prefix = np.select([form == 1, form == 2], [base + MARK, base + 2 * MARK + suffix], base)
    to_suffix = np.select([form == 1, form == 2], [base + 2 * MARK + prefix, base + MARK], two - start + base)
    to_middle = np.where(moved, base + 3 * MARK + prefix + suffix, one - start + base)
    starts = np.stack((start, one, two), axis=1).ravel()
    lengths = np.stack((prefix, middle, suffix), axis=1).ravel()
    goal = np.stack((to_prefix, to_middle, to_suffix), axis=1).ravel()
    for lo, shift in _windows(*_shifts(starts, lengths, goal - starts), len(data)):
        out[np.arange(lo, lo + len(shift)) + shift] = data[lo : lo + len(shift)]
    for mark, before in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k in range(MARK):
            out[before[moved] - MARK + k] = mark[k]
    return out, bounds


def gathered(out: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of all outputs, one after the other, and their bounds; from outputs and forms alone.

    A text that holds a marker is plain, so each marker occurs once in any other output.
    """
    moved = form > 0
    owner_moved = np.flatnonzero(moved)
    lo, hi = bounds[:-1][moved], bounds[1:][moved]
    found = []
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = _marks(out, mark)
        owner = np.searchsorted(bounds, at, "right") - 1
        at = at[moved[owner]] if len(at) else at
        if len(at) != len(owner_moved):
            raise ValueError("an output without its markers")
        found.append(at)
    p, s, m = found
    sizes = np.diff(bounds) - 3 * MARK * moved
    first = _bounds(sizes)
    spm = form[moved] == 2
    from_prefix, from_suffix, from_middle = p + MARK, s + MARK, m + MARK
    prefix = np.where(spm, m, s) - from_prefix
    suffix = np.where(spm, p, m) - from_suffix
    middle = hi - from_middle
    assert (np.where(spm, s, p) == lo).all()
    # Three pieces of each restored text, a plain one has all in the first.
    lengths = np.zeros((len(form), 3), dtype=np.int64)
    source = np.zeros((len(form), 3), dtype=np.int64)
    lengths[~moved, 0], source[~moved, 0] = sizes[~moved], bounds[:-1][~moved]
    lengths[moved] = np.stack((prefix, middle, suffix), axis=1)
    source[moved] = np.stack((from_prefix, from_middle, from_suffix), axis=1)
    lengths, source = lengths.ravel(), source.ravel()
    starts = _bounds(lengths)[:-1]
    text = np.empty(first[-1], dtype=np.uint8)
    for at, shift in _windows(*_shifts(starts, lengths, source - starts), len(text)):
        text[at : at + len(shift)] = out[np.arange(at, at + len(shift)) + shift]
    return text, first


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a byte array, without a copy per row."""
    return pa.Array.from_buffers(
        pa.large_string(), len(bounds) - 1,
        [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)],
    ).cast(pa.string())


def _code_points(data: np.ndarray, first: np.ndarray, one: np.ndarray, two: np.ndarray):
    """Code points of prefixes and middles: bytes that do not continue a character."""
    places = np.stack((first[:-1], one, two), axis=1).ravel()
    below = np.zeros(len(places), dtype=np.int64)
    seen = 0
    for lo in range(0, len(data), WINDOW):
        part = data[lo : lo + WINDOW]
        counts = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        inside = slice(*np.searchsorted(places, (lo + 1, lo + len(part) + 1)))
        below[inside] = seen + counts[places[inside] - lo]
        seen += int(counts[-1])
    below = below.reshape(-1, 3)
    return below[:, 1] - below[:, 0], below[:, 2] - below[:, 1]


FORMS = (PLAIN, PSM, SPM)
_MADE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.string()),
    ]
)


def _draw(doc_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight hex digits of the SHA-256 of ``seed:doc_id``, as a number."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.substring(F.sha2(said, 256), 8 * k + 1, 8)
    return F.conv(digits, 16, 10).cast("long")


def transform(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, one row per input row.

    Draws depend on ``seed`` and the id alone; ``rate`` of a hundred texts are transformed, of these
    ``spm_rate`` of a hundred with the suffix first. A null text is empty, an empty text and a text
    that holds a marker are plain, with null piece sizes. A null id draws as the empty text, rows
    that repeat an id draw alike. Other columns are left out. An empty table gives no rows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [text.encode() for text in rows["text"].to_pylist()]
            draws = np.stack([rows[f"h{k}"].to_numpy() for k in range(4)], axis=1)
            for lo, hi in chunks(texts, CHUNK_BYTES):
                data, first = _joined(texts[lo:hi])
                own = draws[lo:hi]
                n, one, two = line_cuts(data, first, own[:, :2])
                form = np.where(own[:, 3] % 100 < spm_rate, 2, 1)
                form[(first[1:] == first[:-1]) | (own[:, 2] % 100 >= rate)] = 0
                for mark in (PREFIX, SUFFIX, MIDDLE):
                    form[np.searchsorted(first, _marks_inside(data, first, mark), "right") - 1] = 0
                prefix, middle = _code_points(data, first, one, two)
                out, bounds = scattered(data, first, one, two, form)
                plain = form == 0
                yield batch(
                    {
                        "doc_id": rows["doc_id"].slice(lo, hi - lo), "n": n,
                        "form": [FORMS[k] for k in form],
                        "prefix_chars": pa.array(prefix, mask=plain),
                        "middle_chars": pa.array(middle, mask=plain),
                        "output": _strings(out, bounds),
                    },
                    _MADE,
                )

    wanted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    drawn = wanted.select("*", *[_draw(F.col("doc_id"), seed, k).alias(f"h{k}") for k in range(4)])
    return drawn.mapInArrow(
        make,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def _marks_inside(data: np.ndarray, first: np.ndarray, mark: bytes) -> np.ndarray:
    """Places of markers that lie in one text, not across two neighbours."""
    at = _marks(data, mark)
    return at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + MARK - 1, "right")]


def restore(
    made: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored"
) -> DataFrame:
    """``made`` with the text rebuilt from output and form, in ``restored_col``."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [text.encode() for text in rows[output_col].to_pylist()]
            codes = np.array([FORMS.index(f) for f in rows[form_col].to_pylist()], dtype=np.int64)
            for lo, hi in chunks(texts, CHUNK_BYTES):
                data, bounds = _joined(texts[lo:hi])
                text, first = gathered(data, bounds, codes[lo:hi])
                own = rows.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, _strings(text, first)], names=[*own.schema.names, restored_col]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(rebuild, f"{fields}, `{restored_col}` string")


def digests(made: DataFrame) -> DataFrame:
    """The contract's columns of transformed and restored documents."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
