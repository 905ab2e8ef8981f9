"""Scalar, IN, EXISTS and quantified subqueries as joins on aggregated or distinct keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.plans import basic
from stmtlens.sources.workload import Workload

NO_ORDERS_SINCE = dt.date(2000, 6, 1)


def scalar_subquery(w: Workload) -> DataFrame:
    """COUNT of nothing is 0, SUM of nothing is NULL."""
    return (
        w.customers()
        .where(F.col("status") == "ACTIVE")
        .join(basic.order_totals(w), "customer_id", "left")
        .select(
            "customer_id", "customer_name", "email",
            F.coalesce("order_count", F.lit(0)).alias("order_count"), "total_spent",
        )
    )


def _customers_with_orders_over(w: Workload, amount: int) -> DataFrame:
    large = w.orders(since=basic.ORDERS_SINCE).where(F.col("total_amount") > amount)
    # Distinct keys first: a hot customer contributes one row per task instead of all its orders.
    keys = large.select("customer_id").distinct()
    return (
        w.customers()
        .join(keys, "customer_id", "left_semi")
        .select("customer_id", "customer_name", "email", "customer_tier")
    )


def in_subquery(w: Workload) -> DataFrame:
    return _customers_with_orders_over(w, 100000)


def correlated_avg(w: Workload) -> DataFrame:
    """Orders above their customer's average.

    The average is aggregated and joined back rather than computed in a window: a window would sort
    all orders of a hot customer in one task.
    """
    orders = w.orders().select("order_id", "customer_id", "order_date", "total_amount")
    averages = orders.groupBy("customer_id").agg(
        (F.sum("total_amount").cast("double") / F.count("total_amount")).alias("average")
    )
    return (
        orders.join(averages, "customer_id")
        .where(F.col("total_amount") > F.col("average"))
        .select("order_id", "customer_id", "order_date", "total_amount")
    )


def derived_table(w: Workload) -> DataFrame:
    recent = (
        w.orders(since=basic.ORDERS_SINCE)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("total_amount").alias("total_revenue"),
            (F.sum("total_amount").cast("double") / F.count("total_amount")).alias(
                "avg_order_value"
            ),
        )
    )
    return recent.join(w.customers().select("customer_id", "customer_name"), "customer_id").select(
        "customer_id", "customer_name", "order_count", "total_revenue", "avg_order_value"
    )


def nested_in(w: Workload) -> DataFrame:
    electronics = w.products().where(F.col("category") == "Electronics").select("product_id")
    order_ids = w.order_items().join(electronics, "product_id", "left_semi").select("order_id").distinct()
    customer_ids = w.orders().join(order_ids, "order_id", "left_semi").select("customer_id").distinct()
    return (
        w.customers()
        .join(customer_ids, "customer_id", "left_semi")
        .select("customer_id", "customer_name", "email")
    )


def exists(w: Workload) -> DataFrame:
    return _customers_with_orders_over(w, 250000)


def not_exists(w: Workload) -> DataFrame:
    recent = w.orders(since=NO_ORDERS_SINCE).select("customer_id").distinct()
    return (
        w.customers_with_spend()
        .join(recent, "customer_id", "left_anti")
        .select("customer_id", "customer_name", "email", "last_order_date")
    )


def greater_than_all(w: Workload) -> DataFrame:
    """Price above every per-order average of the product.

    True without any group; never true when a group's average is NULL.
    """
    per_order = w.order_items().groupBy("product_id", "order_id").agg(
        F.try_divide(F.sum("unit_price").cast("double"), F.count("unit_price")).alias("average")
    )
    per_product = per_order.groupBy("product_id").agg(
        F.max("average").alias("highest"),
        F.bool_or(F.col("average").isNull()).alias("has_null"),
    )
    return (
        w.products()
        .join(per_product, "product_id", "left")
        .where(
            F.col("has_null").isNull()
            | (~F.col("has_null") & (F.col("unit_price") > F.col("highest")))
        )
        .select("product_id", "product_name", "category", "unit_price")
    )


QUERIES = {
    "w0301_scalar_subquery": scalar_subquery,
    "w0302_in_subquery": in_subquery,
    "w0303_correlated_avg": correlated_avg,
    "w0304_derived_table": derived_table,
    "w0305_nested_in": nested_in,
    "w0306_exists": exists,
    "w0307_not_exists": not_exists,
    "w0308_gt_all": greater_than_all,
}
