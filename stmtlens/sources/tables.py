"""Reading the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_schemas: dict[tuple[str, str], T.StructType] = {}


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``. Its schema is read from a file footer once per application."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)
