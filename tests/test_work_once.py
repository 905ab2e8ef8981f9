"""Texts are worked on once, and by all cores: seen in plans, as results are the same either way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from stmtlens.functions import text as tx
from stmtlens.operators import analysis, metadata
from stmtlens.operators.statements import with_inferred_type
from stmtlens.plans import crossdb
from stmtlens.session import fresh_path, spread
from stmtlens.sinks import reports as report_sinks
from stmtlens.sources import statement_log as log
from stmtlens.sources.workload import Workload


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def one_file(spark, df, name):
    """A folder with ``name`` as one file of one row group."""
    folder = fresh_path(spark, "tables")
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def folder(spark):
    events = spark.range(400).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "id % 7 AS user_id",
        "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'{}' AS props",
    )
    return one_file(spark, events, "events")


def test_procedure_steps_are_cleaned_once(spark):
    body = "CREATE PROCEDURE p() BEGIN SEL 1; IF a THEN UPDATE t SET a = 1; END IF; DELETE FROM t; END;"
    rows = spark.range(2).select(F.col("id").alias("script_id"), F.lit(body).alias("body"))
    rows = rows.repartition(2)
    found = analysis.procedure_statements(rows)
    assert plan(found).count("PROCEDURE\\b") == 1
    got = {(r["step"], r["query_text"], r["statement_type"]) for r in found.collect()}
    assert got == {(1, "SEL 1", "SELECT"), (2, "UPDATE t SET a = 1", "UPDATE"), (4, "DELETE FROM t", "DELETE")}


def test_types_are_inferred_once_under_a_filter(spark, folder):
    typed = with_inferred_type(log.statements(spark, folder))
    assert plan(typed.where(F.col("inferred_type") == "MERGE")).count("/\\*.*?\\*/") <= 2


def test_identifiers_are_cleaned_once(spark):
    rows = spark.range(1).select(F.col("id").cast("string").alias("text")).repartition(1)
    found = rows.select(tx.sanitized_identifier(F.concat("text", F.lit("-mark!")), "none").alias("x"))
    assert plan(found).count("-mark!") == 1
    assert found.first()["x"] == "0-mark"


@pytest.mark.parametrize(
    "text, want",
    [(None, None), ("", "none"), (" 　_! ", "none"), ("__A__b  c\\d/", "a_b_c\\d/"), ("é x é", "x"), ("a\n_;b", "a_b")],
)
def test_identifier_text(spark, text, want):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(tx.sanitized_identifier(F.col("text"), "none").alias("x")).first()["x"] == want


def test_splits_without_rows_do_not_count(spark, folder):
    """A file of one row group in many splits: one of them reads all rows."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        table = spark.read.parquet(f"{folder}/events.parquet")
        cores = spark.sparkContext.defaultParallelism
        assert 2 * table.rdd.getNumPartitions() > cores
        used = spread(table).select(F.spark_partition_id()).distinct().count()
        assert used >= min(cores, table.rdd.getNumPartitions())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_customers_are_dealt_to_all_cores(spark):
    rows = spark.range(200).selectExpr(
        "id AS c_custkey", "'n' AS c_name", "id AS c_nationkey", "1.0D AS c_acctbal", "'X' AS c_mktsegment"
    )
    folder = one_file(spark, rows, "customer")
    suppliers = spark.range(3).selectExpr(
        "id AS s_suppkey", "'s' AS s_name", "id AS s_nationkey", "1.0D AS s_acctbal"
    )
    suppliers.coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    customers = Workload(spark, folder).customers(dealt=True)
    cores = spark.sparkContext.defaultParallelism
    assert customers.select(F.spark_partition_id()).distinct().count() >= cores
    assert customers.count() == 203


def test_report_tables_share_one_pass(spark, folder):
    tables = report_sinks.source_reports(log.outcomes(spark, folder))
    assert all("event_id" not in plan(table) for table in tables.values())


def test_records_share_one_pass(spark, folder):
    place = ["script_id", "stmt_index"]
    inputs = metadata.record_inputs(log.outcomes(spark, folder), place)
    assert "event_id" not in plan(metadata.metadata_records(inputs, place=place))


def test_joins_of_many_rows_get_more_tasks(spark, monkeypatch):
    """Also if the session has few partitions; nothing is broadcast here."""
    monkeypatch.setattr(crossdb, "TASK_ROWS", 50)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.range(1000).selectExpr("id % 300 AS order_id", "id AS item")
        orders = spark.range(300).selectExpr("id AS order_id", "id % 40 AS customer_id")
        found = items.join(crossdb._dealt(orders, "order_id", items.count()), "order_id")
        assert found.count() == 1000
        text = found._jdf.queryExecution().executedPlan().toString()
        assert text.count("hashpartitioning(order_id") == text.count(", 20)") == 2
        assert crossdb._dealt(orders, "order_id", 100) is orders
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
