"""Semi-structured values, lateral joins, wide and deep queries, table functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.operators import slices
from stmtlens.session import written
from stmtlens.plans import basic
from stmtlens.plans.windows import AS_OF, recent_orders
from stmtlens.sources.workload import Workload

REPORT_TIME = "2001-08-01 00:00:00"
WIDE_CATEGORIES = ["Electronics", "Home & Garden", "Clothing"]
SEGMENT_RANGE = (dt.date(2000, 1, 1), dt.date(2000, 12, 31))


def json_functions(w: Workload) -> DataFrame:
    value = lambda column, path: F.get_json_object(column, path)
    return (
        w.customers()
        .where(value("preferences", "$.active") == "true")
        .select(
            "customer_id", "customer_name",
            value("preferences", "$.email_opt_in").alias("email_opt_in"),
            value("preferences", "$.favorite_category").alias("favorite_category"),
            value("metadata", "$.source").alias("data_source"),
        )
    )


def unnest(w: Workload) -> DataFrame:
    return (
        w.customers()
        .where(F.col("status") == "ACTIVE")
        .select(
            "customer_id", "customer_name", F.explode(F.split("tags_csv", ",")).alias("tag_value")
        )
    )


def wide_query(w: Workload) -> DataFrame:
    """Order lines with customer windows and a rank within the category.

    The join is made once and written; all windows start from it. Customer totals are aggregated and
    joined back. The row number has no group limit, so it is computed slice by slice. A category holds a third of all rows: its distinct amounts are counted
    and ranked slice by slice, and the rank is joined back by amount.
    """
    customers = w.customers_with_spend().where(F.col("status") == "ACTIVE").select(
        "customer_id", "customer_name", "email", "status", "customer_tier", "registration_date",
        "total_spent", "last_order_date", "order_count",
    )
    orders = w.orders(since=basic.ORDERS_SINCE).select(
        "order_id", "customer_id", "order_date", F.col("total_amount").alias("order_total"),
        F.col("status").alias("order_status"),
    )
    products = (
        w.products()
        .where(F.col("category").isin(WIDE_CATEGORIES))
        .withColumnRenamed("unit_price", "product_unit_price")
    )
    lines = (
        w.order_items()
        .join(products, "product_id")
        .join(orders, "order_id")
        .join(customers, "customer_id")
        .withColumn("line_item_total", F.col("quantity") * F.col("unit_price"))
    )
    by_customer = slices.with_ranks(
        written(lines, "wide_lines"),
        ["customer_id"],
        [("order_date", "desc")],
        [(c, "asc") for c in ["order_item_id", "product_id", "quantity", "unit_price"]],
    )
    ranked = by_customer.withColumnRenamed("row_number", "customer_order_seq").drop(
        "rank", "dense_rank", "group_rows"
    )
    by_amount = slices.value_ranks(ranked, ["category"], "line_item_total", "desc").select(
        F.col("category").alias("_category"),
        F.col("line_item_total").alias("_amount"),
        F.col("rank").alias("category_sales_rank"),
    )
    same_amount = (F.col("category") == F.col("_category")) & F.col("line_item_total").eqNullSafe(
        F.col("_amount")
    )
    totals = ranked.groupBy("customer_id").agg(
        F.sum("line_item_total").alias("customer_total_value"),
        (F.sum("line_item_total").cast("double") / F.count(F.lit(1))).alias(
            "customer_avg_line_value"
        ),
        F.count(F.lit(1)).alias("customer_line_count"),
    )
    amount, tier = F.col("line_item_total"), F.col("customer_tier")
    day = F.col("order_date")
    return (
        ranked.join(totals, "customer_id")
        .join(by_amount, same_amount)
        .select(
            "customer_id", "customer_name", "email", "status", "customer_tier",
            "registration_date", "total_spent", "last_order_date", "order_count", "order_id",
            "order_date", "order_total", "order_status", "order_item_id", "quantity",
            "unit_price", "line_item_total", "product_id", "product_name", "category",
            "description", "product_unit_price",
            F.when(tier == "PLATINUM", amount * F.lit(0.80).cast("decimal(3,2)"))
            .when(tier == "GOLD", amount * F.lit(0.85).cast("decimal(3,2)"))
            .when(tier == "SILVER", amount * F.lit(0.90).cast("decimal(3,2)"))
            .otherwise(amount)
            .alias("discounted_total"),
            F.lit(AS_OF).alias("report_date"),
            F.lit(REPORT_TIME).cast("timestamp").alias("report_timestamp"),
            F.year(day).cast("bigint").alias("order_year"),
            F.month(day).cast("bigint").alias("order_month"),
            F.dayofmonth(day).cast("bigint").alias("order_day"),
            F.dayofweek(day).cast("bigint").alias("order_day_of_week"),
            F.datediff(F.lit(AS_OF), day).cast("bigint").alias("days_since_order"),
            "customer_order_seq",
            "category_sales_rank",
            "customer_total_value", "customer_avg_line_value", "customer_line_count",
        )
        .orderBy("customer_id", F.col("order_date").desc())
    )


def deep_nesting(w: Workload) -> DataFrame:
    """Four levels of filters collapse to one; a NULL total never passes, so the join is inner."""
    totals = w.orders().groupBy("customer_id").agg(F.sum("total_amount").alias("total_order_value"))
    kept = totals.where(
        (F.col("total_order_value") > 30000) & (F.col("total_order_value") < 3000000)
    )
    return (
        w.customers()
        .where(F.col("customer_name").isNotNull())
        .join(kept, "customer_id")
        .select("customer_id", "customer_name", "total_order_value")
        .orderBy(F.col("total_order_value").desc())
    )


def identifier(w: Workload) -> DataFrame:
    view = "stmtlens_customers"
    w.customers_with_spend().createOrReplaceTempView(view)
    return w.spark.sql(
        "SELECT customer_id, customer_name, total_spent FROM IDENTIFIER(:name)"
        " WHERE status = 'ACTIVE'",
        args={"name": view},
    )


def xml_functions(w: Workload) -> DataFrame:
    """Each of the four paths parses the text: rows that weigh little and take long."""
    data = F.col("customer_data")
    return (
        w.customers(dealt=True)
        .where(F.xpath_boolean(data, F.lit('/customer/preferences[email_opt_in="true"]')))
        .select(
            "customer_id", "customer_name",
            F.xpath_string(data, F.lit("/customer/preferences/email_opt_in")).alias("email_opt_in"),
            F.xpath_string(data, F.lit("/customer/address/city")).alias("city"),
            F.xpath_string(data, F.lit("/customer/address/country")).alias("country"),
        )
    )


def lateral_topk(w: Workload) -> DataFrame:
    """The five newest orders of each active customer, cut down before the join."""
    active = w.customers().where(F.col("status") == "ACTIVE").select("customer_id", "customer_name")
    return active.join(recent_orders(w, 5).drop("order_sequence"), "customer_id").select(
        "customer_id", "customer_name", "order_id", "order_date", "total_amount"
    )


def customer_segments(w: Workload, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Table function: score is 100 times the percent rank of spend in the range."""
    spend = (
        w.orders(since=first_day, before=last_day + dt.timedelta(days=1))
        .groupBy("customer_id")
        .agg(F.sum("total_amount").alias("spend"))
    )
    ranked = slices.with_ranks(spend, [], [("spend", "asc")], [("customer_id", "asc")])
    score = slices.percent_rank(F.col("rank"), F.col("group_rows")) * 100
    band = F.col("segment_score")
    return (
        ranked.withColumn("segment_score", F.round(score, 6))
        .join(w.customers().select("customer_id", "customer_name"), "customer_id")
        .select(
            "customer_id",
            "customer_name",
            F.when(band > 95, "TOP").when(band > 80, "HIGH").when(band > 40, "MIDDLE")
            .otherwise("LOW").alias("segment_name"),
            "segment_score",
        )
    )


def table_function(w: Workload) -> DataFrame:
    return customer_segments(w, *SEGMENT_RANGE).where(F.col("segment_score") > 80)


QUERIES = {
    "w0701_json": json_functions,
    "w0702_unnest": unnest,
    "w0703_wide_query": wide_query,
    "w0704_deep_nesting": deep_nesting,
    "w0705_identifier": identifier,
    "w0706_xml": xml_functions,
    "w0707_lateral_topk": lateral_topk,
    "w0708_table_function": table_function,
}
