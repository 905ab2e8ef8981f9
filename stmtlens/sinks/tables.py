"""Tables written from queries: CREATE TABLE AS, INSERT, CREATE VIEW."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stmtlens.operators.tables import by_position


def create_table_as(df: DataFrame, name: str, path: str) -> DataFrame:
    """CREATE TABLE name AS df, stored as parquet below ``path``."""
    df.write.format("parquet").mode("errorifexists").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def insert_into(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """INSERT INTO name (columns) df: positional; table columns not named become NULL."""
    spark = df.sparkSession
    target = spark.table(name)
    named = by_position(df, columns or target.columns)
    aligned = spark.createDataFrame([], target.schema).unionByName(
        named, allowMissingColumns=True
    )
    aligned.write.insertInto(name)
    return spark.table(name)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """CREATE OR REPLACE VIEW, read back through the catalogue."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
