"""Records laid out in sending order, so that sending can stop anywhere and go on.

Every record gets its place in the one order of all records, from 0 without a gap: ranks of slices
plus what the slices before hold. Records lie in parts of equal length by place, each one file in
order. A manifest has one row per part. A part is marked once all of it has been sent; whatever is
lost on the way, what remains to be sent is the parts without a mark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.operators.slices import with_ranks
from stmtlens.session import discard, written

PART_ROWS = 10_000


def with_sequence(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``sequence``, the 0-based place by ``order`` (nulls first); the order must be total."""
    columns = records.columns
    ranked = with_ranks(records, [], [(name, "asc") for name in order])
    return ranked.select(*columns, (F.col("row_number") - 1).alias("sequence"))


def lay_out(records: DataFrame, order: Sequence[str], path: str, part_rows: int = PART_ROWS) -> None:
    """Write ``records`` below ``path``: one file of JSON lines per part, and the manifest.

    The records are written before they get their places: the cuts of the slices read them too.
    """
    spark = records.sparkSession
    records = written(records, "records")
    placed = with_sequence(records, order)
    part = F.floor(F.col("sequence") / part_rows).cast("bigint").alias("part")
    in_parts = placed.select("*", part).repartition("part").sortWithinPartitions("part", "sequence")
    in_parts.write.partitionBy("part").json(f"{path}/parts")
    discard(records)
    laid = _parts(spark, path, placed.schema.toDDL())
    manifest = laid.groupBy("part").agg(
        F.min("sequence").alias("first"), F.count(F.lit(1)).alias("records"),
        F.bit_xor(F.xxhash64(*placed.columns)).alias("checksum"),
    )
    manifest.coalesce(1).sortWithinPartitions("part").write.parquet(f"{path}/manifest")


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part BIGINT").json(f"{path}/parts")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, first, records, checksum, sent``, one row per part."""
    parts = spark.read.parquet(f"{path}/manifest")
    return parts.join(F.broadcast(_marks(spark, path)), "part", "left").withColumn(
        "sent", F.coalesce("sent", F.lit(False))
    )


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """Marked parts. The folder of marks has a first one that names no part, so it can be read."""
    marks = f"{path}/marks"
    system = spark._jvm.org.apache.hadoop.fs.Path(marks)
    if not system.getFileSystem(spark._jsc.hadoopConfiguration()).exists(system):
        spark.createDataFrame([(None,)], "part long").write.mode("append").parquet(marks)
    found = spark.read.schema("part long").parquet(marks).where("part IS NOT NULL").distinct()
    return found.withColumn("sent", F.lit(True))


def mark_sent(spark: SparkSession, path: str, parts: Sequence[int]) -> None:
    """Mark parts of which every record has been sent. Marking a part again changes nothing."""
    _marks(spark, path)
    spark.createDataFrame([(p,) for p in parts], "part long").coalesce(1).write.mode("append").parquet(
        f"{path}/marks"
    )


def unsent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the parts without a mark. ``schema`` is that of the records with ``sequence``."""
    left = manifest(spark, path).where(~F.col("sent")).select("part")
    laid = _parts(spark, path, schema)
    return laid.join(F.broadcast(left), "part", "left_semi").select(laid.columns)
