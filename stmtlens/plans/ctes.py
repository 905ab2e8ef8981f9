"""Chained and recursive subplans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.operators.hierarchy import paths_from_roots
from stmtlens.plans import basic
from stmtlens.sources.workload import Workload


def single_cte(w: Workload) -> DataFrame:
    active = w.customers_with_spend().where(F.col("status") == "ACTIVE")
    return active.where(F.col("total_spent") > 30000).select(
        "customer_id", "customer_name", "email", "total_spent"
    )


def dependent_ctes(w: Workload) -> DataFrame:
    totals = w.orders().groupBy("customer_id").agg(
        F.sum("total_amount").alias("total_revenue"), F.count(F.lit(1)).alias("order_count")
    )
    return (
        w.customers()
        .join(totals.where(F.col("total_revenue") > 150000), "customer_id")
        .select("customer_id", "customer_name", "email", "total_revenue", "order_count")
        .orderBy(F.col("total_revenue").desc())
    )


def nested_cte(w: Workload) -> DataFrame:
    """Product list per order, sorted by name.

    Equal names of an order are counted first (map-side), so the list that is collected has one
    entry per distinct name.
    """
    lines = w.order_items().join(
        w.products().select("product_id", "product_name"), "product_id"
    )
    per_name = lines.groupBy("order_id", "product_name").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(F.col("quantity") * F.col("unit_price")).alias("amount"),
    )
    listed = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("product_name", "copies"))),
            lambda e: F.array_repeat(e["product_name"], e["copies"].cast("int")),
        )
    )
    totals = (
        per_name.groupBy("order_id")
        .agg(
            F.sum("copies").alias("item_count"),
            F.sum("amount").alias("order_total"),
            F.array_join(listed, ", ").alias("products"),
        )
        .where(F.col("order_total") > 500)
    )
    orders = w.orders().select("order_id", "customer_id", "order_date")
    return orders.join(totals, "order_id").select(
        "order_id", "customer_id", "order_date", "item_count", "order_total", "products"
    )


def recursive_cte(w: Workload) -> DataFrame:
    employees = w.employees().select("employee_id", "employee_name", "manager_id")
    return paths_from_roots(employees, "employee_id", "manager_id", "employee_name").orderBy(
        "level", "employee_name"
    )


def cte_insert(w: Workload) -> DataFrame:
    """Customers with orders: the count filter makes the left join an inner one."""
    metrics = w.customers().select("customer_id", "customer_name").join(
        basic.order_totals(w).where(F.col("order_count") > 0), "customer_id"
    )
    columns = ["customer_id", "customer_name", "order_count", "total_spent", "last_order_date"]
    summary = basic.filled_summary(w)
    summary.insert(metrics.select(*columns), columns)
    return summary.rows()


def independent_ctes(w: Workload) -> DataFrame:
    stats = w.orders().groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lifetime_orders"), F.sum("total_amount").alias("lifetime_value")
    )
    return (
        w.customers()
        .join(stats, "customer_id", "left")
        .select(
            "customer_id", "customer_name", "customer_tier", "lifetime_orders", "lifetime_value"
        )
    )


QUERIES = {
    "w0201_single_cte": single_cte,
    "w0202_dependent_ctes": dependent_ctes,
    "w0203_nested_cte": nested_cte,
    "w0204_recursive_cte": recursive_cte,
    "w0205_cte_insert": cte_insert,
    "w0206_independent_ctes": independent_ctes,
}
