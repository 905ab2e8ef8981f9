"""Helpers shared by the text operators: documents, blocks of documents, and words in numpy.

Several operators must look up something about *every* word, line or window of a document in a
table over the whole corpus. They share one plan:

1. documents are dealt into blocks by a hash of their id (one shuffle of the texts),
2. each block reports each distinct key once, already aggregated over the block,
3. the keys are settled over all blocks, and
4. the answers return to their block, where the texts still lie (the same shuffle is reused).

A key that a third of all documents hold thus travels once per block and never as one row per
document, and no table has to be broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLOCKS_PER_PARTITION = 4


def block_count(spark: SparkSession, per_partition: int = BLOCKS_PER_PARTITION) -> int:
    """Blocks follow ``spark.sql.shuffle.partitions``, which a user sets by the size of the data."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_of(doc_id: Column, text: Column, blocks: int) -> Column:
    """All rows of one id lie in one block; rows without an id are spread by their text."""
    return F.pmod(
        F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)),
        F.lit(blocks),
    ).cast("int")


def in_blocks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_partition: int = BLOCKS_PER_PARTITION,
) -> DataFrame:
    """Columns ``doc_id`` (long), ``text`` (null: empty) and ``block``; other columns are left out."""
    blocks = block_count(docs.sparkSession, per_partition)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")
    ).withColumn("block", block_of(F.col("doc_id"), F.col("text"), blocks))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")
    )


def chunks(texts: list[bytes], size: int):
    """Index ranges of consecutive texts of about ``size`` bytes, so that arrays stay small."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([batch(columns, schema)], schema=schema)


def runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
