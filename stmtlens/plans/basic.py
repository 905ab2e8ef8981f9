"""Simple selects, joins, set operations and row changes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.operators import tables
from stmtlens.session import fresh_path
from stmtlens.sinks import tables as sinks
from stmtlens.sinks.targets import Target
from stmtlens.sources.workload import Workload

ORDERS_SINCE = dt.date(2000, 1, 1)
REGISTERED_SINCE = dt.date(1996, 1, 1)
OLD_ORDERS_BEFORE = dt.date(1996, 1, 1)
CUSTOMER_ARCHIVE = (
    "customer_id BIGINT, customer_name STRING, status STRING, email STRING, customer_tier STRING"
)
SUMMARY_COLUMNS = ["customer_id", "customer_name", "total_spent", "order_count", "last_order_date"]


def simple_select(w: Workload) -> DataFrame:
    return (
        w.customers()
        .where(F.col("status") == "ACTIVE")
        .select("customer_id", "customer_name", "email")
    )


def select_star(w: Workload) -> DataFrame:
    return w.customers_with_spend().where(F.col("registration_date") >= F.lit(REGISTERED_SINCE))


def inner_join(w: Workload) -> DataFrame:
    recent = w.orders(since=ORDERS_SINCE)
    return (
        w.customers()
        .join(recent.drop("status"), "customer_id")
        .select("customer_id", "customer_name", "order_id", "order_date", "total_amount")
    )


def order_totals(w: Workload) -> DataFrame:
    """Orders per customer. Aggregated before any join, so a hot customer shrinks to one row."""
    return w.orders().groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"),
        F.sum("total_amount").alias("total_spent"),
        F.max("order_date").alias("last_order_date"),
    )


def left_join_agg(w: Workload) -> DataFrame:
    return (
        w.customers()
        .join(order_totals(w), "customer_id", "left")
        .select(
            "customer_id",
            "customer_name",
            F.coalesce("order_count", F.lit(0)).alias("order_count"),
            "total_spent",
        )
    )


def right_join(w: Workload) -> DataFrame:
    """Sales with their employee, if any.

    Sales without an employee match nothing, but all carry the same NULL key; a second key spreads
    them over many partitions.
    """
    # Always 0, but not a literal: a literal would be taken out of the join keys.
    zero = F.col("employee_id") % 1
    employees = w.employees().withColumn("_spread", zero)
    elsewhere = 1 + F.pmod("sale_id", F.lit(1000))
    sales = w.sales().withColumn(
        "_spread", F.when(F.col("employee_id").isNull(), elsewhere).otherwise(zero)
    )
    same = (employees["employee_id"] == sales["employee_id"]) & (
        employees["_spread"] == sales["_spread"]
    )
    return employees.join(sales, same, "right").select(
        employees["employee_id"], "employee_name", "sale_id", "sales_amount", "sale_date"
    )


def active_summary(w: Workload) -> DataFrame:
    return w.customers_with_spend().where(F.col("status") == "ACTIVE").select(*SUMMARY_COLUMNS)


def target(w: Workload, name: str, schema: str) -> Target:
    """An empty table of its own for each run of a query."""
    return Target.create(w.spark, f"{name}_{uuid.uuid4().hex}", schema, fresh_path(w.spark, name))


CUSTOMER_SUMMARY = (
    "customer_id BIGINT, customer_name STRING, email STRING, total_spent DECIMAL(25,2), "
    "order_count BIGINT, last_order_date DATE"
)


def filled_summary(w: Workload) -> Target:
    """The summary as it stands before an insert: the inactive customers, with all columns."""
    summary = target(w, "customer_summary", CUSTOMER_SUMMARY)
    known = w.customers_with_spend().where(F.col("status") == "INACTIVE")
    summary.insert(known.select(*summary.columns), batch="before")
    return summary


def insert_select(w: Workload) -> DataFrame:
    summary = filled_summary(w)
    summary.insert(active_summary(w), SUMMARY_COLUMNS)
    return summary.rows()


def order_details(w: Workload) -> DataFrame:
    orders = w.orders().select("order_id", "customer_id", "order_date")
    products = w.products().select("product_id", "product_name")
    return (
        w.order_items()
        .join(orders, "order_id")
        .join(products, "product_id")
        .select(
            "order_id", "customer_id", "order_date", "order_item_id", "product_id",
            "product_name", "quantity", "unit_price",
            (F.col("quantity") * F.col("unit_price")).alias("line_total"),
        )
    )


def ctas(w: Workload) -> DataFrame:
    return sinks.create_table_as(
        order_details(w), f"order_details_{uuid.uuid4().hex}", fresh_path(w.spark, "order_details")
    )


def customer_order_view(w: Workload) -> DataFrame:
    customers = w.customers().select("customer_id", "customer_name", "email")
    joined = customers.join(w.orders(), "customer_id", "left")
    return sinks.create_view(joined, "stmtlens_customer_order_view")


def union_all(w: Workload) -> DataFrame:
    customers = w.customers().select(
        F.col("customer_id").alias("id"), F.col("customer_name").alias("name"), "email",
        F.lit("CUSTOMER").alias("source_type"),
    )
    employees = w.employees().select(
        "employee_id", "employee_name", F.col("employee_id").cast("varchar(100)"),
        F.lit("EMPLOYEE"),
    )
    return customers.unionAll(employees)


def update_join(w: Workload) -> DataFrame:
    large = w.orders().where(F.col("total_amount") > 400000)
    customers = w.customers().select("customer_id", "customer_name", "customer_tier")
    return tables.updated_where_matched(
        customers, large, "customer_id", {"customer_tier": F.lit("GOLD")}
    )


def delete_in(w: Workload) -> DataFrame:
    old = w.orders(before=OLD_ORDERS_BEFORE)
    customers = w.customers().select("customer_id", "customer_name", "status")
    return tables.deleted_in(customers, old, "customer_id")


def union_distinct(w: Workload) -> DataFrame:
    customers = w.customers_with_spend()
    columns = ["customer_id", "customer_name"]
    gold = w.customers().where(F.col("customer_tier") == "GOLD").select(*columns)
    rich = customers.where(F.col("total_spent") > 1500000).select(*columns)
    return gold.union(rich).distinct()


QUERIES = {
    "w0101_simple_select": simple_select,
    "w0102_select_star": select_star,
    "w0103_inner_join": inner_join,
    "w0104_left_join_agg": left_join_agg,
    "w0105_right_join": right_join,
    "w0106_insert_select": insert_select,
    "w0107_ctas": ctas,
    "w0108_create_view": customer_order_view,
    "w0109_union_all": union_all,
    "w0110_update_join": update_join,
    "w0111_delete_in": delete_in,
    "w0112_union_distinct": union_distinct,
}
