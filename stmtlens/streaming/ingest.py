"""Loading script files as they arrive: the directory source, run incrementally.

Splitting and classification look at one script at a time, so the batch functions apply to a stream
unchanged and need no state. Each file is read once; progress is kept in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stmtlens.operators.statements import split_statements, with_inferred_type
from stmtlens.sources.files import whole_scripts, with_file_identity


def statement_stream(
    spark: SparkSession, folder: str, pattern: str = "*.sql", files_per_batch: int = 10_000
) -> DataFrame:
    """Statements of the files below ``folder``, with their inferred type."""
    files = (
        spark.readStream.schema("value string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .format("text")
        .load(folder)
    )
    return with_inferred_type(with_file_identity(split_statements(whole_scripts(files))))


def append_statements(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run to ``path``, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
