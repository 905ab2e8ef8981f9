"""Row changes on tables kept as files: each returns the table as it is after the change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated_where_matched(
    target: DataFrame, keys: DataFrame, on: str, assignments: dict[str, Column]
) -> DataFrame:
    """UPDATE ... FROM: assign in rows whose key occurs in ``keys`` (NULL keys never match).

    The source keys are made distinct first (map-side combine), so many source rows per target
    neither multiply rows nor make a hot key travel.
    """
    matched = (
        keys.select(F.col(on).alias("_key"))
        .where(F.col("_key").isNotNull())
        .distinct()
        .withColumn("_matched", F.lit(True))
    )
    joined = target.join(matched, target[on] == matched["_key"], "left")
    return joined.select(
        *[
            F.when(F.col("_matched"), assignments[c]).otherwise(target[c]).alias(c)
            if c in assignments
            else target[c]
            for c in target.columns
        ]
    )


def deleted_in(target: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """DELETE WHERE key IN (...): a NULL key satisfies no IN, so its row stays."""
    return target.join(keys.select(on).distinct(), on, "left_anti").select(*target.columns)


def merged(
    target: DataFrame,
    source: DataFrame,
    on: str,
    update: Sequence[str],
    insert: Sequence[str],
) -> DataFrame:
    """MERGE: matched rows take ``update`` columns, new rows take ``insert`` columns, others NULL.

    A source key that occurs twice makes the update ambiguous; such a merge is refused, as it is in
    SQL. The check counts keys only.
    """
    repeated = (
        source.where(F.col(on).isNotNull())
        .groupBy(on)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    if not repeated.isEmpty():
        raise ValueError(f"merge: source key {on!r} is not unique")
    new = source.select(
        F.col(on).alias("_key"),
        F.lit(True).alias("_in_source"),
        *[F.col(c).alias(f"_new_{c}") for c in sorted({*update, *insert})],
    )
    old = target.withColumn("_in_target", F.lit(True))
    joined = old.join(new, old[on] == new["_key"], "full_outer")
    is_new = F.col("_in_target").isNull()
    is_match = F.col("_in_target") & F.col("_in_source")

    def column(name: str) -> Column:
        value = F.col(name)
        if name in update:
            value = F.when(is_match, F.col(f"_new_{name}")).otherwise(value)
        if name in insert:
            value = F.when(is_new, F.col(f"_new_{name}")).otherwise(value)
        return value.alias(name)

    return joined.select(*[column(c) for c in target.columns])


def by_position(source: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """INSERT maps columns by position, whatever their names."""
    return source.toDF(*target_columns)
