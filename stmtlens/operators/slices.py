"""Ordered computations over groups of any size, in one exchange.

A window over a hot group (or over the whole table) runs in one task. So rows are cut into slices of
about equal size along (group, order), whatever the sizes of the groups. The cuts are weighted
quantiles of a sample: each task keeps a few rows and says how many each of them stands for, and such
samples merge by putting them together. A row's slice is its place among the cuts, found by a binary
search in built-in expressions; only the window over (slice, group) moves rows. Where the cuts fall
changes the work and never a result.

Each slice is computed on its own and written once, and only groups cut by a slice boundary need a
correction. At most one group crosses each boundary, so the correction table holds at most two rows
per slice and is safe to broadcast whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtlens.session import written

SLICE = "_slice"
# Rows that the sample holds for each slice: slices are uneven by some 15 percent.
SAMPLED = 50
Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc")


def _sort(order: Order) -> list[Column]:
    return [
        F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first()
        for name, way in order
    ]


def _falling(name: str, kind: T.DataType) -> list[Column]:
    """Values whose rising order is the falling order of a column, nulls last."""
    value = F.col(name)
    if isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    if isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType)):
        return [value.isNull(), F.bitwise_not(value)]
    if isinstance(kind, T.BooleanType):
        return [value.isNull(), ~value]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [value.isNull(), ~F.isnan(value), -value]
    if isinstance(kind, T.StringType):
        # Bytes from the other end, and behind a text what no byte follows.
        digits = "0123456789ABCDEF"
        return [value.isNull(), F.concat(F.translate(F.hex(value), digits, digits[::-1]), F.lit("G"))]
    if isinstance(kind, T.DecimalType):
        return [value.isNull(), -value]
    raise TypeError(f"no falling order for {name!r} of type {kind.simpleString()}")


def _coordinates(df: DataFrame, keys: Sequence[str], order: Order) -> list[Column]:
    """Values along which rows are cut: nulls first, rising."""
    found = [F.col(k) for k in keys]
    for name, way in order:
        found += [F.col(name)] if way == "asc" else _falling(name, df.schema[name].dataType)
    return [c.alias(f"c{i}") for i, c in enumerate(found)]


def _cuts(places: DataFrame, slices: int) -> list[Row]:
    """At most ``slices - 1`` rows of ``places`` that cut it into about equal parts."""
    tasks = max(places.rdd.getNumPartitions(), 1)
    size = max(SAMPLED * slices // tasks, 20)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, kept, drawn, n = np.random.default_rng(7), None, np.zeros(0), 0
        for rows in batches:
            n += rows.num_rows
            drawn = np.concatenate((drawn, turn.random(rows.num_rows)))
            own = pa.Table.from_batches([rows])
            kept = own if kept is None else pa.concat_tables([kept, own])
            if len(drawn) > size:
                least = np.argpartition(drawn, size)[:size]
                drawn, kept = drawn[least], kept.take(pa.array(least)).combine_chunks()
        if n:
            weight = pa.array(np.full(kept.num_rows, n / kept.num_rows))
            yield from kept.append_column("weight", weight).to_batches()

    schema = T.StructType([*places.schema.fields, T.StructField("weight", T.DoubleType())])
    sampled = places.mapInArrow(sample, schema)
    # A row per task and slice at most: few enough for one task.
    by = Window.orderBy(*places.columns)
    upto = F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.floor(F.col("upto") * slices / F.sum("weight").over(Window.partitionBy()))
    placed = sampled.withColumn("upto", upto).withColumn("part", part)
    first = F.row_number().over(Window.partitionBy("part").orderBy(*places.columns))
    inner = (F.col("first") == 1) & F.col("part").between(1, slices - 1)
    cuts = placed.withColumn("first", first).where(inner)
    return cuts.select(places.columns).distinct().orderBy(*places.columns).collect()


def _sliced(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Add the number of each row's slice; numbers rise along (keys, order)."""
    coordinates = _coordinates(df, keys, order)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = df.select(*coordinates)
    cuts = _cuts(places, slices)
    row = F.struct(*coordinates)

    def bound(cut: Row) -> Column:
        fields = zip(cut, places.schema)
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in fields])

    bounds = F.array(*map(bound, cuts))
    at = F.lit(0)
    if cuts:
        widths = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        at = F.aggregate(
            F.array(*map(F.lit, widths)), at,
            lambda at, width: F.when(
                (at + width <= len(cuts)) & (F.get(bounds, at + width - 1) <= row), at + width
            ).otherwise(at),
        )
    return df.withColumn(SLICE, at)


def _window(keys: Sequence[str], order: Order = ()):
    window = Window.partitionBy(SLICE, *keys)
    return window.orderBy(*_sort(order)) if order else window


def _cut_groups(laid: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``laid`` whose group continues in another slice.

    ``heads`` holds one row per (slice, group). The cut groups are the last group of a slice that is
    also the first of the next one: fewer rows than slices.
    """
    if not keys:
        return laid
    key = F.struct(*keys)
    ends = heads.groupBy(SLICE).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    following = F.lead("_lo").over(Window.orderBy(SLICE))
    cut = (
        ends.withColumn("_next", following)
        .where(F.col("_hi").eqNullSafe(F.col("_next")))
        .select("_hi.*")
        .distinct()
        .toDF(*[f"_cut_{k}" for k in keys])
    )
    same = [laid[k].eqNullSafe(cut[f"_cut_{k}"]) for k in keys]
    return laid.join(F.broadcast(cut), same, "left_semi")


def _corrected(laid: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the per (slice, group) corrections; groups inside one slice get NULLs."""
    renamed = edges.withColumnsRenamed({k: f"_edge_{k}" for k in [SLICE, *keys]})
    same = [laid[k].eqNullSafe(renamed[f"_edge_{k}"]) for k in [SLICE, *keys]]
    return laid.join(F.broadcast(renamed), same, "left").drop(
        *[f"_edge_{k}" for k in [SLICE, *keys]]
    )


def with_ranks(
    df: DataFrame, keys: Sequence[str], order: Order, tie_break: Order = ()
) -> DataFrame:
    """Add ``row_number``, ``rank``, ``dense_rank`` and ``group_rows`` within ``keys``.

    ``order`` decides rank and dense rank; ``tie_break`` completes the order for the row number.
    """
    columns = df.columns
    full = [*order, *tie_break]
    laid = written(
        _sliced(df, keys, full)
        .withColumn("_rn", F.row_number().over(_window(keys, full)))
        .withColumn("_rk", F.rank().over(_window(keys, order)))
        .withColumn("_dr", F.dense_rank().over(_window(keys, order)))
        .withColumn("_rows", F.count(F.lit(1)).over(_window(keys))),
        "ranks",
    )
    value = F.struct(*[name for name, _ in order])
    heads = laid.where(F.col("_rn") == 1)
    slices = (
        _cut_groups(laid, heads, keys)
        .groupBy(SLICE, *keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_dr").alias("_values"),
            F.max("_rk").alias("_last_rank"),
            F.max(F.when(F.col("_rn") == 1, value)).alias("_first"),
            F.max_by(value, "_rn").alias("_last"),
        )
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        slices.withColumn("_rows_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        # Does this slice go on with the value that ended the slice before?
        .withColumn(
            "_goes_on",
            (F.row_number().over(along) > 1)
            & F.col("_first").eqNullSafe(F.lag("_last").over(along)),
        )
        .withColumn(
            "_last_start",
            F.when(
                ~(F.col("_goes_on") & (F.col("_values") == 1)),
                F.col("_rows_before") + F.col("_last_rank"),
            ),
        )
        .withColumn("_run_start", F.last("_last_start", ignorenulls=True).over(earlier))
        .withColumn(
            "_first_rank",
            F.when(F.col("_goes_on"), F.col("_run_start")).otherwise(F.col("_rows_before") + 1),
        )
        .withColumn("_new_values", F.col("_values") - F.col("_goes_on").cast("int"))
        .withColumn(
            "_values_before",
            F.coalesce(F.sum("_new_values").over(earlier), F.lit(0))
            - F.col("_goes_on").cast("int"),
        )
        .withColumn("_group_rows", F.sum("_n").over(Window.partitionBy(*keys)))
        .select(
            SLICE, *keys, "_rows_before", "_first_rank", "_values_before", "_group_rows"
        )
    )
    zero = F.lit(0).cast("bigint")
    before = F.coalesce(F.col("_rows_before"), zero)
    return _corrected(laid, edges, keys).select(
        *columns,
        (before + F.col("_rn")).alias("row_number"),
        F.when(F.col("_rk") == 1, F.coalesce(F.col("_first_rank"), F.lit(1).cast("bigint")))
        .otherwise(before + F.col("_rk"))
        .alias("rank"),
        (F.coalesce(F.col("_values_before"), zero) + F.col("_dr")).alias("dense_rank"),
        F.coalesce(F.col("_group_rows"), F.col("_rows")).alias("group_rows"),
    )


def ntile(tiles: int, row_number: Column, group_rows: Column) -> Column:
    """NTILE from a row number: the first ``rows % tiles`` tiles hold one row more."""
    size = F.floor(group_rows / tiles)
    larger = group_rows % tiles
    in_larger = larger * (size + 1)
    return (
        F.when(row_number <= in_larger, F.floor((row_number - 1) / (size + 1)) + 1)
        .otherwise(larger + F.floor((row_number - in_larger - 1) / F.greatest(size, F.lit(1))) + 1)
        .cast("bigint")
    )


def percent_rank(rank: Column, group_rows: Column) -> Column:
    return F.when(group_rows > 1, (rank - 1) / (group_rows - 1)).otherwise(F.lit(0.0))


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Order, column: str) -> DataFrame:
    """Add the value of ``column`` in the row before and after within ``keys``.

    Adds ``previous``, ``following``, ``has_previous`` and ``has_following``. ``order`` must be
    total, so that slices and neighbours are well defined.
    """
    columns = df.columns
    here = _window(keys, order)
    laid = written(
        _sliced(df, keys, order)
        .withColumn("_rn", F.row_number().over(here))
        .withColumn("_before", F.lag(column).over(here))
        .withColumn("_after", F.lead(column).over(here))
        .withColumn("_rows", F.count(F.lit(1)).over(_window(keys))),
        "neighbours",
    )
    is_first, is_last = F.col("_rn") == 1, F.col("_rn") == F.col("_rows")
    ends = laid.where(is_first | is_last)
    box = F.struct(F.col(column).alias("value"))
    slices = (
        _cut_groups(ends, laid.where(is_first), keys)
        .groupBy(SLICE, *keys)
        .agg(
            F.max(F.when(is_first, box)).alias("_first"),
            F.max(F.when(is_last, box)).alias("_last"),
        )
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    edges = slices.select(
        SLICE,
        *keys,
        F.lag("_last").over(along).alias("_box_before"),
        F.lead("_first").over(along).alias("_box_after"),
    )
    return _corrected(laid, edges, keys).select(
        *columns,
        F.when(is_first, F.col("_box_before.value")).otherwise(F.col("_before")).alias("previous"),
        F.when(is_last, F.col("_box_after.value")).otherwise(F.col("_after")).alias("following"),
        (~is_first | F.col("_box_before").isNotNull()).alias("has_previous"),
        (~is_last | F.col("_box_after").isNotNull()).alias("has_following"),
    )


@dataclass(frozen=True)
class CountedValues:
    """Distinct values per group with their counts and running counts.

    ``table`` has the keys, ``_value``, ``_n`` (rows with the value), ``_rn`` and ``_upto`` (values
    and rows up to it in its slice), ``_rows`` and ``_values`` (rows and values of the group in the
    slice) and the slice.
    """

    table: DataFrame
    keys: list[str]


def counted_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: dict[str, Column] | None = None,
) -> CountedValues:
    """Count equal values per group, before any shuffle, and order them within the group.

    ``extra`` adds further aggregates per value, so that reports can be finished from this table
    without another pass over the rows.
    """
    keys = list(keys)
    counted = written(
        df.groupBy(*keys, F.col(value).alias("_value")).agg(
            F.count(F.lit(1)).alias("_n"),
            *[measure.alias(name) for name, measure in (extra or {}).items()],
        ),
        "counts",
    )
    order = [("_value", "asc")]

    here = _window(keys, order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = _sliced(counted, keys, order).select(
        "*",
        F.row_number().over(here).alias("_rn"),
        F.sum("_n").over(upto).alias("_upto"),
        F.sum("_n").over(_window(keys)).alias("_rows"),
        F.count(F.lit(1)).over(_window(keys)).alias("_values"),
    )
    return CountedValues(written(laid, "values"), keys)


def _with_positions(values: CountedValues) -> DataFrame:
    """Add the first and last 0-based position of each value in its group, the rank of the value
    among the distinct ones, and the size of the group."""
    laid, keys = values.table, values.keys
    slices = (
        _cut_groups(laid, laid.where(F.col("_rn") == 1), keys)
        .groupBy(SLICE, *keys)
        .agg(F.sum("_n").alias("_slice_rows"), F.count(F.lit(1)).alias("_slice_values"))
    )
    along = Window.partitionBy(*keys)
    earlier = along.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    edges = slices.select(
        SLICE,
        *keys,
        F.sum("_slice_rows").over(earlier).alias("_rows_before"),
        F.sum("_slice_values").over(earlier).alias("_values_before"),
        F.sum("_slice_rows").over(along).alias("_group_rows"),
        F.sum("_slice_values").over(along).alias("_group_values"),
    )
    laid = _corrected(laid, edges, keys)
    zero = F.lit(0).cast("bigint")
    return (
        laid.withColumn("_last", F.coalesce(F.col("_rows_before"), zero) + F.col("_upto") - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
        .withColumn("_dense", F.coalesce(F.col("_values_before"), zero) + F.col("_rn"))
        .withColumn("_total", F.coalesce(F.col("_group_rows"), F.col("_rows")))
        .withColumn("_total_values", F.coalesce(F.col("_group_values"), F.col("_values")))
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, way: str = "asc") -> DataFrame:
    """Rank and dense rank of each distinct value per group: (keys, value, rank, dense_rank).

    For ranks without a row number this moves only keys and values, not the rows. NULL comes first
    in rising and last in falling order; join back with a null-safe comparison.
    """
    placed = _with_positions(counted_values(df, keys, value))
    if way == "asc":
        rank, dense = F.col("_first") + 1, F.col("_dense")
    else:
        # Counted from the other end.
        rank = F.col("_total") - F.col("_last")
        dense = F.col("_total_values") - F.col("_dense") + 1
    return placed.select(
        *keys,
        F.col("_value").alias(value),
        rank.alias("rank"),
        dense.alias("dense_rank"),
    )


def percentiles_of(values: CountedValues, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation at (n - 1) * q from ``counted_values``.

    Only the few values that cover a wanted position reach the last aggregation.
    """
    placed, keys = _with_positions(values), values.keys

    def covers(position: Column) -> Column:
        return (F.col("_first") <= position) & (position <= F.col("_last"))

    needed, picks, results = F.lit(False), [], []
    for name, q in quantiles.items():
        at = (F.col("_total") - 1) * F.lit(q)
        low, high = covers(F.floor(at)), covers(F.ceil(at))
        needed = needed | low | high
        picks.append(F.max(F.when(low, F.col("_value"))).alias(f"_low_{name}"))
        picks.append(F.max(F.when(high, F.col("_value"))).alias(f"_high_{name}"))
        weight = at - F.floor(at)
        results.append(
            (F.col(f"_low_{name}") * (1 - weight) + F.col(f"_high_{name}") * weight).alias(name)
        )
    picks.append(F.max("_total").alias("_total"))
    return placed.where(needed).groupBy(*keys).agg(*picks).select(*keys, *results)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact percentiles, one row per group.

    ``percentile`` keeps the value counts of a whole group in one task's memory; here the counted
    values are ordered slice by slice.
    """
    present = df.where(F.col(value).isNotNull())
    return percentiles_of(counted_values(present, keys, value), quantiles)
