"""MERGE, windows, searched CASE, positional insert, pivot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtlens.operators import slices, tables
from stmtlens.plans import basic
from stmtlens.sources.workload import Workload

AS_OF = dt.date(2001, 8, 1)
PIVOT_YEARS = [1998, 1999, 2000]


def day_before(days: int) -> dt.date:
    return AS_OF - dt.timedelta(days=days)


def days_ago(days: int):
    return F.lit(day_before(days))


def merge(w: Workload) -> DataFrame:
    target = w.customers().select(
        "customer_id", "customer_name", "email", "status", "customer_tier", "registration_date"
    )
    return tables.merged(
        target,
        w.customers_staging(),
        on="customer_id",
        update=["customer_name", "email", "customer_tier"],
        insert=["customer_id", "customer_name", "email", "status", "customer_tier"],
    )


def recent_orders(w: Workload, limit: int) -> DataFrame:
    """The newest orders of each customer; ties by order id.

    The rank filter becomes a group limit before the shuffle: every task keeps ``limit`` rows per
    customer, so a hot customer is cut down where it is read.
    """
    newest = Window.partitionBy("customer_id").orderBy(F.col("order_date").desc(), "order_id")
    return (
        w.orders()
        .select("order_id", "customer_id", "order_date", "total_amount")
        .withColumn("order_sequence", F.row_number().over(newest))
        .where(F.col("order_sequence") <= limit)
    )


def row_number_qualify(w: Workload) -> DataFrame:
    return recent_orders(w, 5).withColumn("order_sequence", F.col("order_sequence").cast("bigint"))


def rank_ntile(w: Workload) -> DataFrame:
    """Ranks over the whole table, computed slice by slice instead of in one task."""
    active = (
        w.customers_with_spend()
        .where(F.col("status") == "ACTIVE")
        .select("customer_id", "customer_name", "total_spent")
    )
    ranked = slices.with_ranks(active, [], [("total_spent", "desc")], [("customer_id", "asc")])
    return ranked.select(
        "customer_id",
        "customer_name",
        "total_spent",
        F.col("rank").alias("spending_rank"),
        F.col("dense_rank").alias("dense_spending_rank"),
        slices.ntile(10, F.col("row_number"), F.col("group_rows")).alias("spending_decile"),
    )


def lag_lead(w: Workload) -> DataFrame:
    orders = w.orders().select("order_id", "customer_id", "order_date", "total_amount")
    order = [("order_date", "asc"), ("order_id", "asc")]
    near = slices.with_neighbours(orders, ["customer_id"], order, "total_amount")
    before = F.when(F.col("has_previous"), F.col("previous")).otherwise(F.lit(0))
    return near.select(
        "order_id", "customer_id", "order_date", "total_amount",
        F.col("previous").alias("previous_order_amount"),
        F.col("following").alias("next_order_amount"),
        (F.col("total_amount") - before).alias("amount_change"),
    )


def searched_case(w: Workload) -> DataFrame:
    spent, count, last = F.col("total_spent"), F.col("order_count"), F.col("last_order_date")
    return w.customers_with_spend().select(
        "customer_id", "customer_name", "total_spent", "order_count",
        F.when(spent > 3000000, "PLATINUM")
        .when(spent > 2500000, "GOLD")
        .when(spent > 1750000, "SILVER")
        .otherwise("BRONZE")
        .alias("customer_tier"),
        F.when(count == 0, "NEVER_ORDERED")
        .when(last < days_ago(90), "DORMANT")
        .when(last < days_ago(30), "AT_RISK")
        .otherwise("ACTIVE")
        .alias("customer_status"),
        F.when(count > 0, spent.cast("double") / count).otherwise(F.lit(0.0)).alias("avg_order_value"),
    )


def qualify_join(w: Workload) -> DataFrame:
    """The largest order of each customer, found before the join."""
    largest = Window.partitionBy("customer_id").orderBy(F.col("total_amount").desc(), "order_id")
    top = (
        w.orders()
        .select("order_id", "customer_id", "order_date", "total_amount")
        .withColumn("order_rank", F.row_number().over(largest))
        .where(F.col("order_rank") == 1)
    )
    return (
        w.customers()
        .join(top, "customer_id")
        .select(
            "customer_id", "customer_name", "order_id", "order_date", "total_amount",
            F.col("order_rank").cast("bigint").alias("order_rank"),
        )
    )


def insert_positional(w: Workload) -> DataFrame:
    rows = (
        w.customers()
        .where(F.col("status") == "INACTIVE")
        .select("customer_id", "email", "customer_tier", "customer_name", "status")
    )
    archive = basic.target(w, "customer_archive", basic.CUSTOMER_ARCHIVE)
    known = w.customers().where(F.col("customer_tier") == "PLATINUM")
    archive.insert(known.select(*archive.columns), batch="before")
    archive.insert(rows)
    return archive.rows()


def pivot(w: Workload) -> DataFrame:
    """Spend per customer and year; the wanted years are known, so no discovery pass runs."""
    years = (
        w.orders()
        .select("customer_id", F.year("order_date").alias("order_year"), "total_amount")
        .groupBy("customer_id")
        .pivot("order_year", PIVOT_YEARS)
        .agg(F.sum("total_amount"))
    )
    return years.withColumnsRenamed({str(y): f"spend_{y}" for y in PIVOT_YEARS})


QUERIES = {
    "w0401_merge": merge,
    "w0402_row_number_qualify": row_number_qualify,
    "w0403_rank_ntile": rank_ntile,
    "w0404_lag_lead": lag_lead,
    "w0405_case": searched_case,
    "w0406_qualify_join": qualify_join,
    "w0407_insert_positional": insert_positional,
    "w0408_pivot": pivot,
}
