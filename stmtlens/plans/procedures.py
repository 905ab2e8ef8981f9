"""Procedure bodies as set-based jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.plans import basic
from stmtlens.plans.windows import AS_OF, day_before
from stmtlens.sources.workload import Workload

TIER_CUSTOMER = 7
MACRO_CUSTOMER = 7
DYNAMIC_TABLES = {
    "customers": lambda w: w.customers_with_spend(),
    "customers_archive": lambda w: w.customers_with_spend().where("status = 'INACTIVE'"),
}


def proc_insert(w: Workload) -> DataFrame:
    """A procedure with one insert, run twice for one day: the second run finds its batch there."""
    summary = basic.filled_summary(w)
    for _ in range(2):
        summary.insert(basic.active_summary(w), basic.SUMMARY_COLUMNS, batch=f"load-{AS_OF}")
    return summary.rows()


def proc_pipeline(w: Workload) -> DataFrame:
    """Replace the staging rows by the last 30 days, then add them to the summary.

    Several staged orders per customer are aggregated first, so every order counts once.
    """
    staged = w.orders(since=day_before(30))
    delta = staged.groupBy(F.col("customer_id").alias("_customer")).agg(
        F.count(F.lit(1)).alias("_orders"), F.sum("total_amount").alias("_amount")
    )
    summary = w.customers_with_spend().select("customer_id", "order_count", "total_spent")
    return summary.join(delta, F.col("customer_id") == F.col("_customer"), "left").select(
        "customer_id",
        (F.col("order_count") + F.coalesce("_orders", F.lit(0))).alias("order_count"),
        # NULL + amount stays NULL, as in the update it stands for.
        F.when(F.col("_customer").isNull(), F.col("total_spent"))
        .otherwise(F.col("total_spent") + F.col("_amount"))
        .alias("total_spent"),
    )


def proc_if(w: Workload, customer_id: int = TIER_CUSTOMER) -> DataFrame:
    """IF / ELSEIF / ELSE on one customer; a NULL total takes the ELSE branch."""
    spent = F.col("total_spent")
    tier = (
        F.when(spent > 3000000, "PLATINUM").when(spent > 1500000, "GOLD").otherwise("SILVER")
    )
    return w.customers_with_spend().select(
        "customer_id",
        "customer_name",
        F.when(F.col("customer_id") == customer_id, tier)
        .otherwise(F.col("customer_tier"))
        .alias("customer_tier"),
    )


def dynamic_table(w: Workload, table_name: str = "customers") -> DataFrame:
    """The table is named at run time; only listed names are allowed."""
    if table_name not in DYNAMIC_TABLES:
        raise ValueError(f"table {table_name!r} is not on the list")
    view = f"stmtlens_{table_name}"
    DYNAMIC_TABLES[table_name](w).createOrReplaceTempView(view)
    return w.spark.sql(
        "SELECT customer_id, customer_name, total_spent FROM IDENTIFIER(:name)",
        args={"name": view},
    )


def macro(w: Workload, customer_id: int = MACRO_CUSTOMER) -> DataFrame:
    """A parameterised query: the key filter reaches both scans."""
    return w.spark.sql(
        """
        SELECT o.order_id, o.order_date, o.total_amount, o.status, c.customer_name, c.email
        FROM {orders} o JOIN {customers} c ON o.customer_id = c.customer_id
        WHERE o.customer_id = :customer_id
        ORDER BY o.order_date DESC
        """,
        args={"customer_id": customer_id},
        orders=w.orders(),
        customers=w.customers(),
    )


def cursor_loop(w: Workload) -> DataFrame:
    """One update for all active keys instead of one per fetched row."""
    summary = w.customers().select("customer_id", "customer_name")
    active = (
        w.customers()
        .where(F.col("status") == "ACTIVE")
        .select(F.col("customer_id").alias("_key"))
        .distinct()
    )
    return summary.join(active, F.col("customer_id") == F.col("_key"), "left").select(
        "customer_id",
        "customer_name",
        F.when(F.col("_key").isNotNull(), F.lit(AS_OF)).alias("last_processed_date"),
    )


QUERIES = {
    "w0501_proc_insert": proc_insert,
    "w0502_proc_pipeline": proc_pipeline,
    "w0503_proc_if": proc_if,
    "w0504_dynamic_table": dynamic_table,
    "w0505_macro": macro,
    "w0506_cursor_loop": cursor_loop,
}
