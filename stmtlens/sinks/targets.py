"""Tables that inserts add to, a batch at a time, each published in one step."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtlens.operators.tables import by_position

BATCH = "_batch"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


@dataclass(frozen=True)
class Target:
    """A catalogue table whose partitions are the batches inserted so far.

    A batch is written to a folder of its own first, which no reader looks into; adding it to the
    catalogue as a partition is the one step that publishes it. A job that fails before that leaves
    the table as it was, and a batch that is already there is not inserted again, so a job can be
    repeated. No rows of earlier batches are read or moved.
    """

    spark: SparkSession
    name: str
    folder: str
    columns: tuple[str, ...]

    @classmethod
    def create(cls, spark: SparkSession, name: str, schema: str, folder: str) -> Target:
        """CREATE TABLE name (schema), with its files below ``folder``; an error if there is one."""
        fields = T.StructType.fromDDL(schema)
        spark.sql(
            f"CREATE TABLE {_quoted(name)} ({schema}, `{BATCH}` STRING) USING parquet "
            f"PARTITIONED BY (`{BATCH}`) LOCATION '{folder}/published'"
        )
        return cls(spark, name, folder, tuple(fields.names))

    def batches(self) -> set[str]:
        """Names of the batches that are published."""
        found = self.spark.sql(f"SHOW PARTITIONS {_quoted(self.name)}").collect()
        return {row[0].partition("=")[2] for row in found}

    def insert(self, rows: DataFrame, columns: list[str] | None = None, batch: str | None = None) -> bool:
        """INSERT INTO name (columns) rows: by position, columns not named become NULL.

        Values are cast to the table's types. False if the ``batch`` was there already.
        """
        batch = batch or uuid.uuid4().hex
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        named = by_position(rows, columns or list(self.columns))
        unknown = set(named.columns) - set(self.columns)
        if unknown:
            raise ValueError(f"no such columns in {self.name}: {', '.join(sorted(unknown))}")
        schema = self.spark.table(self.name).schema
        aligned = named.select(
            *[
                (F.col(f"`{c}`") if c in named.columns else F.lit(None)).cast(schema[c].dataType).alias(c)
                for c in self.columns
            ]
        )
        staged = f"{self.folder}/batches/{batch}-{uuid.uuid4().hex}"
        aligned.write.parquet(staged)
        self.spark.sql(
            f"ALTER TABLE {_quoted(self.name)} ADD IF NOT EXISTS "
            f"PARTITION (`{BATCH}` = '{batch}') LOCATION '{staged}'"
        )
        return True

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)
