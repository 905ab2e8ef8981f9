"""Inserts into tables that have rows: by column list, repeated, and failing."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from stmtlens.session import fresh_path
from stmtlens.sinks.targets import Target


@pytest.fixture
def target(spark):
    name = f"target_{uuid.uuid4().hex}"
    made = Target.create(spark, name, "a BIGINT, b STRING, c DECIMAL(10,2)", fresh_path(spark, name))
    made.insert(spark.createDataFrame([(1, "x", 1.5)], "a int, b string, c double"), batch="one")
    return made


def rows(target):
    return sorted((r["a"], r["b"], None if r["c"] is None else float(r["c"])) for r in target.rows().collect())


def test_old_and_new_rows(spark, target):
    assert target.insert(spark.createDataFrame([("y", 2)], "q string, r int"), ["b", "a"])
    assert rows(target) == [(1, "x", 1.5), (2, "y", None)]
    assert rows(target) == sorted(
        (r["a"], r["b"], None if r["c"] is None else float(r["c"])) for r in spark.table(target.name).collect()
    )
    assert target.rows().schema.simpleString() == "struct<a:bigint,b:string,c:decimal(10,2)>"


def test_a_batch_is_inserted_once(spark, target):
    more = spark.createDataFrame([(3, "z", 0.0)], "a int, b string, c double")
    assert target.insert(more, batch="two") and not target.insert(more, batch="two")
    assert not target.insert(more, batch="one")
    assert rows(target) == [(1, "x", 1.5), (3, "z", 0.0)] and target.batches() == {"one", "two"}


def test_a_failing_insert_leaves_the_table_as_it_was(spark, target):
    bad = spark.range(0, 1000, 1, 8).select(
        "id", F.lit("w"), F.when(F.col("id") < 900, 1.0).otherwise(F.raise_error(F.lit("lost")).cast("double"))
    )
    with pytest.raises(Exception, match="lost"):
        target.insert(bad, batch="bad")
    assert rows(target) == [(1, "x", 1.5)] and target.batches() == {"one"}
    assert target.insert(bad.where("id < 3"), batch="bad") and len(rows(target)) == 4


def test_errors(spark, target):
    with pytest.raises(ValueError, match="no such columns"):
        target.insert(spark.range(1), ["q"])
    with pytest.raises(ValueError, match="batch name"):
        target.insert(spark.range(1), ["a"], batch="x' y")
