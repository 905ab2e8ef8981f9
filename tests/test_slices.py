"""Sliced ranks, neighbours and percentiles against brute force, with one hot group."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stmtlens.operators import slices


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Keep all shuffle partitions, so that groups are really cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """Group 0 holds a third of the rows; a third of its values are equal; some are NULL."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        group = 0 if i % 3 == 0 else rng.randrange(1, 40)
        value = None if i % 50 == 0 else (5 if i % 9 == 0 else rng.randrange(200))
        data.append((i, group, value))
    return spark.createDataFrame(data, "id int, g int, v int").repartition(5).cache()


@pytest.fixture(params=[1, 61], autouse=True)
def slice_count(spark, request):
    """One slice, and more than there are groups."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("way", ["asc", "desc"])
def test_ranks(rows, keys, way):
    got = slices.with_ranks(rows, keys, [("v", way)], [("id", "asc")])
    order = F.col("v").asc_nulls_first() if way == "asc" else F.col("v").desc_nulls_last()
    w = Window.partitionBy(*keys)
    want = rows.select(
        "*",
        F.row_number().over(w.orderBy(order, "id")).cast("bigint").alias("row_number"),
        F.rank().over(w.orderBy(order)).cast("bigint").alias("rank"),
        F.dense_rank().over(w.orderBy(order)).cast("bigint").alias("dense_rank"),
        F.count(F.lit(1)).over(w).alias("group_rows"),
        F.ntile(7).over(w.orderBy(order, "id")).cast("bigint").alias("tile"),
    )
    got = got.withColumn("tile", slices.ntile(7, F.col("row_number"), F.col("group_rows")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_slices_are_used(spark, rows, slice_count):
    laid = slices._sliced(rows, ["g"], [("v", "asc"), ("id", "asc")])
    hot = laid.where("g = 0").select(slices.SLICE).distinct().count()
    assert hot > slice_count // 5 or slice_count == 1
    sizes = [r["count"] for r in laid.groupBy(slices.SLICE).count().collect()]
    assert max(sizes) < 2.5 * 3000 / slice_count


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_value_ranks(rows, way):
    order = F.col("v").asc_nulls_first() if way == "asc" else F.col("v").desc_nulls_last()
    w = Window.partitionBy("g").orderBy(order)
    want = rows.select("g", "v", F.rank().over(w), F.dense_rank().over(w)).distinct()
    got = slices.value_ranks(rows, ["g"], "v", way)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_neighbours(rows):
    order = [("v", "asc"), ("id", "asc")]
    got = slices.with_neighbours(rows, ["g"], order, "v")
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "id")
    want = rows.select(
        "*", F.lag("v").over(w), F.lead("v").over(w),
        F.lag(F.lit(True), 1, False).over(w), F.lead(F.lit(True), 1, False).over(w),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_percentiles(rows):
    quantiles = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in slices.exact_percentiles(rows, ["g"], "v", quantiles).collect()}
    groups: dict[int, list[int]] = {}
    for r in rows.collect():
        if r["v"] is not None:
            groups.setdefault(r["g"], []).append(r["v"])
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        assert got[g]["p50"] == pytest.approx(statistics.median(values))
        assert (got[g]["p0"], got[g]["p100"]) == (values[0], values[-1])
        at = (len(values) - 1) * 0.95
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert got[g]["p95"] == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_percentile_of_three(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 4.0)], "k string, v double")
    assert slices.exact_percentiles(df, ["k"], "v", {"p": 0.95}).first()["p"] == pytest.approx(3.8)


def test_slice_numbers_rise_along_any_order(spark, slice_count):
    """Falling numbers, dates, texts, not-a-number and nulls, in every pair of directions."""
    if slice_count == 1:
        return
    rng = random.Random(3)
    data = [
        (i, rng.choice([None, True, False]), rng.choice([None, float("nan"), 1.5, -2.0, 0.0]),
         rng.choice([None, "a", "b", "zz"]), rng.choice([None, 1, -9223372036854775808, 7]))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "id int, b boolean, d double, s string, n long").selectExpr(
        "*", "CAST(n % 1000 AS DECIMAL(20, 2)) AS dec", "date_add(DATE '2020-01-01', id % 9) AS day",
        "TIMESTAMP '2020-01-01 00:00:00' + make_interval(0, 0, 0, id % 5) AS ts",
    )
    for one, two in [("b", "d"), ("d", "n"), ("s", "day"), ("dec", "ts")]:
        for order in ([(one, "desc"), (two, "asc"), ("id", "asc")], [(one, "asc"), (two, "desc"), ("id", "desc")]):
            w = Window.orderBy(*slices._sort(order))
            wrong = slices._sliced(df, [], order).withColumn("before", F.lag(slices.SLICE).over(w))
            assert wrong.where(F.col("before") > F.col(slices.SLICE)).count() == 0, order
