"""Customer 360, sales dashboard, churn, inventory and cohort reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlens.plans import basic
from stmtlens.plans.windows import AS_OF, day_before, days_ago
from stmtlens.sinks.targets import Target
from stmtlens.sources.workload import Workload

COHORTS_SINCE = dt.date(1995, 1, 1)


def customer_360(w: Workload) -> DataFrame:
    """Order history, recent activity and favourite category of every active customer.

    ``order_id`` is the key of orders, so distinct counts of it are plain counts, and history and
    recent activity come from one pass over the orders.
    """
    valid = ~F.col("status").isin("CANCELLED", "REFUNDED")
    recent = F.col("order_date") >= days_ago(90)
    amount, day = F.col("total_amount"), F.col("order_date")
    history = (
        w.orders()
        .where(valid | recent)
        .groupBy("customer_id")
        .agg(
            F.nullif(F.count_if(valid), F.lit(0)).alias("total_orders"),
            F.sum(F.when(valid, amount)).alias("lifetime_value"),
            F.min(F.when(valid, day)).alias("first_order_date"),
            F.max(F.when(valid, day)).alias("last_order_date"),
            F.count_if(recent).alias("orders_last_90_days"),
            F.sum(F.when(recent, amount)).alias("spend_last_90_days"),
        )
        .withColumn("avg_order_value", F.col("lifetime_value").cast("double") / F.col("total_orders"))
        .withColumn(
            "customer_lifetime_days",
            F.datediff("last_order_date", "first_order_date").cast("bigint"),
        )
    )
    favourite = Window.partitionBy("customer_id").orderBy(
        F.col("category_spend").desc(), "preferred_category"
    )
    preferences = (
        w.order_items()
        .join(w.orders().select("order_id", "customer_id"), "order_id")
        .join(w.products().select("product_id", "category"), "product_id")
        .groupBy("customer_id", F.col("category").alias("preferred_category"))
        .agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("category_spend"))
        .withColumn("category_rank", F.row_number().over(favourite))
        .where(F.col("category_rank") == 1)
    )
    last, days = F.col("last_order_date"), F.col("customer_lifetime_days")
    return (
        w.customers()
        .where(F.col("status") == "ACTIVE")
        .join(history, "customer_id", "left")
        .join(preferences, "customer_id", "left")
        .select(
            "customer_id", "customer_name", "email", "status", "customer_tier",
            "registration_date", "total_orders", "lifetime_value", "avg_order_value",
            "first_order_date", "last_order_date", "customer_lifetime_days",
            F.coalesce("orders_last_90_days", F.lit(0)).alias("orders_last_90_days"),
            F.coalesce("spend_last_90_days", F.lit(0)).alias("spend_last_90_days"),
            "preferred_category",
            F.col("category_spend").alias("preferred_category_spend"),
            F.when(last >= days_ago(30), "ACTIVE")
            .when(last >= days_ago(90), "AT_RISK")
            .when(last >= days_ago(180), "DORMANT")
            .otherwise("LOST")
            .alias("engagement_status"),
            F.when(days > 0, F.col("lifetime_value").cast("double") / days)
            .otherwise(F.lit(0.0))
            .alias("daily_value_rate"),
        )
        .orderBy(F.col("lifetime_value").desc())
    )


def _of_schema(w: Workload, name: str, rows: DataFrame) -> Target:
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    return basic.target(w, name, ", ".join(fields))


def sales_dashboard(w: Workload) -> DataFrame:
    """The metrics of the last week, added to those of the week before."""
    rows = daily_metrics(w, day_before(7))
    metrics = _of_schema(w, "sales_daily_metrics", rows)
    metrics.insert(daily_metrics(w, day_before(14), day_before(7)), batch="before")
    metrics.insert(rows)
    return metrics.rows()


def daily_metrics(w: Workload, since: dt.date, before: dt.date | None = None) -> DataFrame:
    """Daily sales by category with rank and share of the day.

    Lines are first combined per order and category; then each order is one row and the two
    distinct counts work on the smaller set. The order average weighs each order by its lines.
    """
    orders = (
        w.orders(since=since, before=before)
        .where(F.col("status") == "COMPLETED")
        .select("order_id", "customer_id", F.col("order_date").alias("report_date"), "total_amount")
    )
    per_order = (
        w.order_items()
        .join(orders, "order_id")
        .join(w.products().select("product_id", F.col("category").alias("product_category")), "product_id")
        .groupBy("report_date", "product_category", "order_id", "customer_id", "total_amount")
        .agg(
            F.sum(F.col("quantity") * F.col("unit_price")).alias("revenue"),
            F.sum("quantity").alias("units"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    daily = per_order.groupBy("report_date", "product_category").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("units").alias("total_units_sold"),
        (F.sum(F.col("total_amount") * F.col("lines")).cast("double") / F.sum("lines")).alias(
            "avg_order_value"
        ),
        F.countDistinct("customer_id").alias("unique_customers"),
    )
    # At most one row per category and day from here on.
    day = Window.partitionBy("report_date")
    day_total = F.sum("total_revenue").over(day).cast("double")
    return daily.select(
        "*",
        F.rank().over(day.orderBy(F.col("total_revenue").desc())).cast("bigint").alias("revenue_rank"),
        F.when(day_total > 0, F.col("total_revenue").cast("double") / day_total * 100)
        .otherwise(F.lit(0.0))
        .alias("revenue_pct_of_total"),
    )


def churn(w: Workload) -> DataFrame:
    """The risks of customers of high value, added to those of the customers below them."""
    rows = churn_risks(w, F.col("total_spent") > 30000)
    risks = _of_schema(w, "customer_churn_risk", rows)
    spent = F.col("total_spent")
    risks.insert(churn_risks(w, (spent > 20000) & (spent <= 30000)), batch="before")
    risks.insert(rows)
    return risks.rows()


def churn_risks(w: Workload, wanted: Column) -> DataFrame:
    customers = (
        w.customers_with_spend()
        .where((F.col("status") == "ACTIVE") & wanted)
        .select(
            "customer_id", "customer_name", "email", "customer_tier",
            F.col("total_spent").alias("lifetime_value"), "last_order_date", "order_count",
            F.datediff(F.lit(AS_OF), "last_order_date").cast("bigint").alias("days_since_last_order"),
            F.when(
                F.col("order_count") > 0,
                F.datediff("last_order_date", "registration_date").cast("double")
                / F.col("order_count"),
            ).alias("avg_days_between_orders"),
        )
    )
    day, amount = F.col("order_date"), F.col("total_amount")
    now = day >= days_ago(90)
    before = (day >= days_ago(180)) & (day < days_ago(90))
    trend = (
        w.orders()
        .where(F.col("status") == "COMPLETED")
        .groupBy("customer_id")
        .agg(
            F.count_if(now).alias("orders_last_90_days"),
            F.count_if(before).alias("orders_90_to_180_days"),
            F.sum(F.when(now, amount).otherwise(F.lit(0))).alias("spend_last_90_days"),
            F.sum(F.when(before, amount).otherwise(F.lit(0))).alias("spend_90_to_180_days"),
        )
    )
    idle = F.col("days_since_last_order")
    orders_now, orders_before = F.col("orders_last_90_days"), F.col("orders_90_to_180_days")
    spend_now, spend_before = F.col("spend_last_90_days"), F.col("spend_90_to_180_days")

    def graded(values: list, rules: list[Column]) -> Column:
        chain = F.when(rules[0], values[0])
        for rule, value in zip(rules[1:], values[1:-1]):
            chain = chain.when(rule, value)
        return chain.otherwise(values[-1])

    recency = [idle > 180, idle > 90, idle > 60]
    frequency = [
        (orders_now == 0) & (orders_before > 0),
        orders_now < orders_before,
        orders_now == orders_before,
    ]
    monetary = [
        (spend_now == 0) & (spend_before > 0),
        spend_now < spend_before * F.lit(0.5).cast("decimal(2,1)"),
        spend_now < spend_before,
    ]
    levels = ["HIGH", "MEDIUM", "LOW", "MINIMAL"]
    score = graded([40, 25, 10, 0], recency) + graded([30, 20, 10, 0], frequency) + graded([30, 20, 10, 0], monetary)
    return customers.join(trend, "customer_id", "left").select(
        *customers.columns,
        "orders_last_90_days", "orders_90_to_180_days", "spend_last_90_days",
        "spend_90_to_180_days",
        graded(levels, recency).alias("recency_risk"),
        graded(levels, frequency).alias("frequency_risk"),
        graded(levels, monetary).alias("monetary_risk"),
        score.cast("int").alias("churn_risk_score"),
        F.lit(AS_OF).alias("analysis_date"),
    )


def inventory(w: Workload) -> DataFrame:
    """Sales velocity, trend and reorder point per product, from one pass over the lines.

    Both halves of the report filter alike, so they share join and aggregation. The sample standard
    deviation follows from exact integer sums, so it does not depend on the order of the rows.
    """
    orders = (
        w.orders(since=day_before(30))
        .where(F.col("status") == "COMPLETED")
        .select("order_id", "order_date")
    )
    quantity, day = F.col("quantity").cast("bigint"), F.col("order_date")
    # One row per product and order: the distinct order count becomes a plain count.
    per_order = (
        w.order_items()
        .select("order_id", "product_id", "quantity")
        .join(orders, "order_id")
        .groupBy("product_id", "order_id", "order_date")
        .agg(
            F.sum(quantity).alias("units"),
            F.sum(quantity * quantity).alias("squares"),
            F.count(F.lit(1)).alias("lines"),
        )
    )

    def units_between(newest: int | None, oldest: int) -> Column:
        inside = day >= days_ago(oldest)
        if newest is not None:
            inside = inside & (day < days_ago(newest))
        return F.sum(F.when(inside, F.col("units")).otherwise(F.lit(0)))

    n, total = F.sum("lines"), F.sum("units")
    velocity = per_order.groupBy("product_id").agg(
        total.alias("units_sold_30d"),
        F.count(F.lit(1)).alias("order_frequency_30d"),
        (total.cast("double") / n).alias("avg_units_per_order"),
        F.when(
            n > 1,
            F.sqrt((n * F.sum("squares") - total * total).cast("double") / (n * (n - 1))),
        ).alias("stddev_units_per_order"),
        F.countDistinct("order_date").alias("days_with_sales"),
        units_between(None, 7).alias("units_sold_7d"),
        units_between(7, 14).alias("units_sold_8_14d"),
        units_between(14, 30).alias("units_sold_15_30d"),
    )
    sold, days = F.col("units_sold_30d"), F.col("days_with_sales")
    daily = F.when(days > 0, sold.cast("double") / days).otherwise(F.lit(0.0))
    week, week_before = F.col("units_sold_7d"), F.col("units_sold_8_14d")
    spread = F.coalesce("stddev_units_per_order", F.lit(0.0))
    return (
        w.products()
        .select("product_id", "product_name", "category", "unit_price")
        .join(velocity.where(sold > 0), "product_id")
        .select(
            "product_id", "product_name", "category", "unit_price", "units_sold_30d",
            "order_frequency_30d", "avg_units_per_order",
            F.round("stddev_units_per_order", 6).alias("stddev_units_per_order"),
            "days_with_sales", "units_sold_7d", "units_sold_8_14d", "units_sold_15_30d",
            daily.alias("daily_sales_velocity"),
            F.when(week > week_before, "ACCELERATING")
            .when(week < week_before * F.lit(0.8).cast("decimal(2,1)"), "DECELERATING")
            .otherwise("STABLE")
            .alias("trend_direction"),
            F.round(daily * 14 + spread * 2, 6).cast("int").alias("recommended_reorder_point"),
            F.round(daily * 30, 6).cast("int").alias("recommended_order_quantity"),
            F.lit(AS_OF).alias("analysis_date"),
        )
        .orderBy(F.col("units_sold_30d").desc())
    )


def cohort(w: Workload) -> DataFrame:
    """Revenue by registration month and months since, with running sums and growth.

    Orders are combined per customer and month before the join, so each customer-month is one row.
    The windows run over one row per cohort and month.
    """
    month = lambda day: F.trunc(day, "month")
    members = (
        w.customers()
        .where(F.col("registration_date") >= F.lit(COHORTS_SINCE))
        .select("customer_id", month(F.col("registration_date")).alias("cohort_month"))
    )
    sizes = members.groupBy("cohort_month").agg(F.count("customer_id").alias("cohort_size"))
    monthly = (
        w.orders()
        .where(F.col("status") == "COMPLETED")
        .groupBy("customer_id", month(F.col("order_date")).alias("revenue_month"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("revenue"))
    )
    revenue = (
        monthly.join(members, "customer_id")
        .groupBy("cohort_month", "revenue_month")
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            F.sum("orders").alias("total_orders"),
            F.sum("revenue").alias("total_revenue"),
            (F.sum("revenue").cast("double") / F.sum("orders")).alias("avg_order_value"),
        )
        .withColumn(
            "months_since_acquisition",
            F.months_between("revenue_month", "cohort_month").cast("bigint"),
        )
    )
    along = Window.partitionBy("cohort_month").orderBy("months_since_acquisition")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("cohort_size")
    return (
        revenue.join(sizes, "cohort_month")
        .withColumn("prev_month_revenue", F.lag("total_revenue", 1).over(along))
        .select(
            "cohort_month", "cohort_size", "months_since_acquisition", "revenue_month",
            "active_customers", "total_orders", "total_revenue", "avg_order_value",
            F.round(F.col("active_customers") * 100.0 / size, 2)
            .cast("decimal(10,2)")
            .alias("customer_retention_pct"),
            F.round(F.col("total_revenue") / size, 2)  # of decimals: ties are exact
            .cast("decimal(15,2)")
            .alias("revenue_per_cohort_customer"),
            F.sum("total_revenue").over(so_far).alias("cumulative_cohort_revenue"),
            F.sum("active_customers").over(so_far).alias("cumulative_active_customers"),
            "prev_month_revenue",
            F.when(
                F.col("prev_month_revenue") > 0,
                F.round(
                    (F.col("total_revenue") - F.col("prev_month_revenue")).cast("decimal(20,2)")
                    * F.lit(100)
                    / F.col("prev_month_revenue").cast("decimal(20,2)"),
                    2,
                ).cast("decimal(10,2)"),
            ).alias("revenue_growth_pct"),
        )
        .orderBy("cohort_month", "months_since_acquisition")
    )


QUERIES = {
    "w0801_customer_360": customer_360,
    "w0802_sales_dashboard": sales_dashboard,
    "w0803_churn": churn,
    "w0804_inventory": inventory,
    "w0805_cohort": cohort,
}
