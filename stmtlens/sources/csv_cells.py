"""One column of CSV files of any size, cut by the scan over many tasks.

A quoted cell may span lines, so a line alone does not tell whether it starts a record. Each line is
a step from one state (outside or inside a quoted cell) to another, for either state it may start
in. A first scan runs these steps over every file block for both states and keeps one small row per
block; the blocks of a file, in order, then settle in which state each starts and how many records
end before it. The second scan reads the records. A record cut by a block boundary leaves a fragment
on either side, and fragments of one record are put together by its number.

The header of each file, its first record, says where the wanted column stands in that file.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.session import written

QUOTE = '"'
OUTSIDE, INSIDE = 0, 1
MARK = "﻿"


def _closed(line: str, at: int) -> int:
    """Place behind the quote that closes a cell, from inside of it; -1 if the line ends before."""
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return -1
        if not line.startswith(QUOTE, at + 1):
            return at + 1
        at += 2


def step(line: str, state: int, delimiter: str) -> int:
    """State behind a line. A quote opens a cell only at its start; others are plain characters."""
    at = 0
    if state == INSIDE:
        at = _closed(line, 0)
        if at < 0:
            return INSIDE
        at = line.find(delimiter, at)
        if at < 0:
            return OUTSIDE
        at += len(delimiter)
    while True:
        if line.startswith(QUOTE, at):
            at = _closed(line, at + 1)
            if at < 0:
                return INSIDE
        at = line.find(delimiter, at)
        if at < 0:
            return OUTSIDE
        at += len(delimiter)


def cells(records: list[str], delimiter: str) -> list[list[str]]:
    """The cells of whole records."""
    csv.field_size_limit(sys.maxsize)
    found = list(csv.reader(records, delimiter=delimiter))
    if len(found) != len(records):  # a file that ends inside a cell
        found = [next(csv.reader([record], delimiter=delimiter), []) for record in records]
    return found


def _block_runs(rows: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Lines of the same block of a file, in the order of the scan."""
    n = rows.num_rows
    if not n:
        return
    paths, blocks = rows["path"], rows["block"].to_numpy()
    new = np.ones(n, dtype=bool)
    new[1:] = blocks[1:] != blocks[:-1]
    if paths[0] != paths[n - 1]:
        new[1:] |= pc.not_equal(paths.slice(1), paths.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    for lo, hi in zip(starts, np.append(starts[1:], n)):
        yield (paths[lo].as_py(), int(blocks[lo])), rows["value"].slice(lo, hi - lo)


class _Summary:
    """What a block does to either state, and the records that end in it."""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter
        self.states, self.ends = [OUTSIDE, INSIDE], [0, 0]
        self.header: str | None = None
        self.first: list[str] = []

    def add(self, lines: pa.Array) -> None:
        filled = np.concatenate(
            ([0], np.cumsum(pc.greater(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)))
        )
        quoted = np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False))
        texts = lines.take(pa.array(quoted)).to_pylist()
        for start in (OUTSIDE, INSIDE):
            state, ends, at = self.states[start], self.ends[start], 0
            for k, text in zip(quoted.tolist(), texts):
                if state == OUTSIDE:
                    ends += int(filled[k] - filled[at])
                state = step(text, state, self.delimiter)
                ends += state == OUTSIDE
                at = k + 1
            if state == OUTSIDE:
                ends += int(filled[-1] - filled[at])
            self.states[start], self.ends[start] = state, ends
        self._look_for_header(lines)

    def _look_for_header(self, lines: pa.Array) -> None:
        if self.header is not None:
            return
        state = INSIDE if self.first else OUTSIDE
        for text in lines:
            text = text.as_py()
            if text or self.first:
                self.first.append(text)
                state = step(text, state, self.delimiter)
                if state == OUTSIDE:
                    self.header = "\n".join(self.first)
                    return


_BLOCKS = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("from_outside", pa.int32()),
     ("from_inside", pa.int32()), ("ends_outside", pa.int64()), ("ends_inside", pa.int64()),
     ("header", pa.list_(pa.string()))]
)


def _blocks(lines: DataFrame, delimiter: str) -> DataFrame:
    """One row per block of each file: the states it leads to, its records, and a file's header."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, int] | None = None
        summary = _Summary(delimiter)

        def told() -> pa.RecordBatch:
            header = None
            if known[1] == 0:
                said = (summary.header or "\n".join(summary.first)).removeprefix(MARK)
                header = cells([said], delimiter)[0] if said else []
            values = [*known, *summary.states, *summary.ends, header]
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCKS.names, values))], schema=_BLOCKS)

        for rows in batches:
            for place, values in _block_runs(rows):
                if place != known:
                    if known:
                        yield told()
                    known, summary = place, _Summary(delimiter)
                summary.add(values)
        if known:
            yield told()

    return lines.mapInArrow(
        summarise,
        "path string, block long, from_outside int, from_inside int, ends_outside long, "
        "ends_inside long, header array<string>",
    )


_PLACES = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("number", pa.int64()),
     ("column", pa.int64()), ("cut", pa.bool_())]
)


def _places(blocks: DataFrame, column: str) -> DataFrame:
    """``path, block, state, number, column, cut``: how each block starts, the records that end
    before it, where the column stands, and whether a record goes on behind the block."""

    def follow(rows: pa.Table) -> pa.Table:
        state, number, column_at, found = OUTSIDE, 0, 0, []
        for row in sorted(rows.to_pylist(), key=lambda r: r["block"]):
            if row["header"] is not None:
                column_at = row["header"].index(column)
            inside = state == INSIDE
            after = row["from_inside"] if inside else row["from_outside"]
            found.append((row["path"], row["block"], state, number, column_at, after == INSIDE))
            number += row["ends_inside"] if inside else row["ends_outside"]
            state = after
        return pa.Table.from_pylist([dict(zip(_PLACES.names, x)) for x in found], schema=_PLACES)

    return blocks.groupBy("path").applyInArrow(
        follow, "path string, block long, state int, number long, column long, cut boolean"
    )


_CELLS = pa.schema(
    [("path", pa.string()), ("number", pa.int64()), ("cell", pa.string()), ("block", pa.int64()),
     ("column", pa.int64())]
)
CELLS = "path string, number long, cell string, block long, column long"


class _Reader:
    """Records of one block, from its starting state and record number on."""

    def __init__(self, place: tuple[str, int], state: int, number: int, column: int, delimiter: str):
        self.place, self.state, self.number, self.column = place, state, number, column
        self.delimiter = delimiter
        self.open: list[str] = []
        self.continued = state == INSIDE
        self.numbers: list[int] = []
        self.records: list[str] = []
        self.fragments: list[tuple[int, str]] = []

    def add(self, lines: pa.Array) -> None:
        quoted = pc.match_substring(lines, QUOTE).to_pylist()
        for text, has_quote in zip(lines.to_pylist(), quoted):
            if has_quote:
                self.state = step(text, self.state, self.delimiter)
            elif self.state == OUTSIDE and not text:
                continue
            if self.state == INSIDE:
                self.open.append(text)
            elif self.open or self.continued:
                self._end("\n".join([*self.open, text]))
            else:
                self._end(text)

    def _end(self, record: str) -> None:
        if self.continued:
            self.fragments.append((self.number, record))
        else:
            self.numbers.append(self.number)
            self.records.append(record)
        self.number += 1
        self.open, self.continued = [], False

    def flush(self, last: bool) -> pa.RecordBatch:
        """What is ready. Fragments carry the place of their block and the whole of their text."""
        if last and self.open:
            self.fragments.append((self.number, "\n".join(self.open)))
        found = [
            row[self.column] if self.column < len(row) else None
            for row in cells(self.records, self.delimiter)
        ]
        path, block = self.place
        n, k = len(found), len(self.fragments)
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array([path] * (n + k), pa.string()),
                pa.array(self.numbers + [i for i, _ in self.fragments], pa.int64()),
                pa.array(found + [text for _, text in self.fragments], pa.string()),
                pa.array([None] * n + [block] * k, pa.int64()),
                pa.array([self.column] * (n + k), pa.int64()),
            ],
            schema=_CELLS,
        )
        self.numbers, self.records, self.fragments = [], [], []
        return rows


def _read(lines: DataFrame, delimiter: str) -> DataFrame:
    """``path, number, cell, block, column``: cells of whole records, and fragments of others, which
    have their ``block``. ``lines`` have the places of their blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, int] | None = None
        reader = None
        for rows in batches:
            at = 0
            for place, values in _block_runs(rows):
                if place != known:
                    if reader:
                        yield reader.flush(last=True)
                    start = [rows[name][at].as_py() for name in ("state", "number", "column")]
                    known, reader = place, _Reader(place, *start, delimiter)
                reader.add(values)
                at += len(values)
            if reader:
                yield reader.flush(last=False)
        if reader:
            yield reader.flush(last=True)

    return lines.mapInArrow(read, CELLS)


def _whole(fragments: DataFrame, delimiter: str) -> DataFrame:
    """``path, number, cell`` of the records that blocks cut: their fragments, in order."""
    pieces = F.array_sort(F.collect_list(F.struct("block", "cell")))
    text = F.array_join(F.transform(pieces, lambda x: x["cell"]), "\n")
    joined = fragments.groupBy("path", "number", "column").agg(text.alias("cell"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = cells(rows["cell"].to_pylist(), delimiter)
            at = rows["column"].to_pylist()
            own = [row[k] if k < len(row) else None for row, k in zip(found, at)]
            yield pa.RecordBatch.from_arrays(
                [rows["path"], rows["number"], pa.array(own, pa.string())],
                names=["path", "number", "cell"],
            )

    return joined.select("path", "number", "column", "cell").mapInArrow(
        parse, "path string, number long, cell string"
    )


def column_cells(
    spark: SparkSession, paths: Sequence[str], column: str, delimiter: str = ",",
    recursive: bool = False,
) -> DataFrame:
    """``path, number, cell`` of one column, by name, in CSV files whose headers may differ.

    ``number`` counts a file's records from 0, its header; empty lines are none. A record that is too
    short has a null cell. Lines end in a line feed, a carriage return or both; inside a cell each of
    these is a line feed. A byte order mark is dropped. A file without the column is an error that
    names both, an empty file has no cells. What is broadcast is one row per file block.
    """
    if len(delimiter) != 1 or delimiter in (QUOTE, "\n", "\r"):
        raise ValueError(f"not a delimiter: {delimiter!r}")
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    lines = reader.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    )
    blocks = written(_blocks(lines, delimiter), "csv-blocks")
    lacking = blocks.where(~F.array_contains("header", column)).select("path", "header").first()
    if lacking:
        raise ValueError(
            f"column {column!r} not found in {lacking['path']}; available: {', '.join(lacking['header'])}"
        )
    places = written(_places(blocks, column), "csv-places")
    found = _read(lines.join(F.broadcast(places), ["path", "block"]), delimiter)
    if places.where("cut").isEmpty():
        return found.where("number > 0").select("path", "number", "cell")
    # Read once, for whole records and fragments.
    found = written(found.where("number > 0"), "csv-cells")
    whole = found.where("block IS NULL").select("path", "number", "cell")
    return whole.unionByName(_whole(found.where("block IS NOT NULL"), delimiter))
