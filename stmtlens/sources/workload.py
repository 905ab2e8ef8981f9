"""Business tables for the workload queries, as views over the given parquet tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlens.session import spread
from stmtlens.sources.tables import parquet_table

MONEY = "decimal(15,2)"
# Keys of prospects start here, above those of all customers.
FIRST_PROSPECT = 10_000_000_000


def _case(value: Column, mapping: dict[str, str], otherwise: str | Column) -> Column:
    chain = None
    for key, result in mapping.items():
        condition = value == key
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain.otherwise(otherwise)


def _days(timestamp: str, since: dt.date | None, before: dt.date | None) -> Column:
    """A range of days on the stored timestamp, where it reaches the scan as a pushed filter.

    A filter on the timestamp cast to a date would not.
    """
    start = lambda day: F.lit(day).cast("timestamp_ntz")
    condition = F.lit(True)
    if since:
        condition = condition & (F.col(timestamp) >= start(since))
    if before:
        condition = condition & (F.col(timestamp) < start(before))
    return condition


class Workload:
    """Lazy views; each reads only what the query on top of it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return parquet_table(self.spark, self.folder, name)

    def people(self) -> DataFrame:
        """Customers, and suppliers as prospects without any order, so that outer joins have
        unmatched rows."""
        customers = self.base("customer").select(
            "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
        )
        prospects = self.base("supplier").select(
            (F.col("s_suppkey") + FIRST_PROSPECT).alias("c_custkey"),
            F.col("s_name").alias("c_name"),
            F.col("s_nationkey").alias("c_nationkey"),
            F.col("s_acctbal").alias("c_acctbal"),
            F.lit("HOUSEHOLD").alias("c_mktsegment"),
        )
        return customers.unionByName(prospects)

    def customers(self, dealt: bool = False) -> DataFrame:
        """Customer attributes that do not depend on orders.

        With ``dealt`` the rows are spread over all cores first, for work that is dear per row.
        """
        key, segment, nation = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey")
        yes_no = lambda condition: F.when(condition, "true").otherwise("false")
        people = spread(self.people()) if dealt else self.people()
        return people.select(
            key.alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_acctbal") >= 0, "ACTIVE").otherwise("INACTIVE").alias("status"),
            _case(
                segment,
                {"BUILDING": "PLATINUM", "MACHINERY": "GOLD", "FURNITURE": "SILVER"},
                "BRONZE",
            ).alias("customer_tier"),
            F.make_date(1994 + key % 3, 1 + key % 9, F.lit(15)).alias("registration_date"),
            nation.alias("region_id"),
            (key % 10).alias("preferred_store_id"),
            F.concat(
                F.lit('{"email_opt_in":"'), yes_no(key % 2 == 0),
                F.lit('","favorite_category":"'), segment,
                F.lit('","active":"'), yes_no(key % 3 != 0), F.lit('"}'),
            ).alias("preferences"),
            F.concat(F.lit('{"source":"src'), (key % 4).cast("string"), F.lit('"}')).alias(
                "metadata"
            ),
            F.concat(
                F.lit("<customer><preferences><email_opt_in>"), yes_no(key % 2 == 0),
                F.lit("</email_opt_in></preferences><address><city>City"), nation.cast("string"),
                F.lit("</city><country>C"), (nation % 5).cast("string"),
                F.lit("</country></address></customer>"),
            ).alias("customer_data"),
            F.concat(F.lower(segment), F.lit(",tag"), (key % 5).cast("string")).alias("tags_csv"),
        )

    def customers_with_spend(self) -> DataFrame:
        """Customers with total_spent, last_order_date and order_count."""
        spend = (
            self.orders()
            .groupBy(F.col("customer_id").alias("_customer"))
            .agg(
                F.sum("total_amount").alias("total_spent"),
                F.max("order_date").alias("last_order_date"),
                F.count(F.lit(1)).alias("_orders"),
            )
        )
        return (
            self.customers()
            .join(spend, F.col("customer_id") == F.col("_customer"), "left")
            .withColumn("order_count", F.coalesce("_orders", F.lit(0)))
            .drop("_customer", "_orders")
        )

    def orders(self, since: dt.date | None = None, before: dt.date | None = None) -> DataFrame:
        """Orders of a range of days (all by default)."""
        return (
            self.base("orders")
            .where(_days("o_orderdate", since, before))
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("o_orderdate").cast("date").alias("order_date"),
                F.col("o_totalprice").cast(MONEY).alias("total_amount"),
                _case(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "OPEN"}, "CANCELLED").alias(
                    "status"
                ),
            )
        )

    def order_items(self) -> DataFrame:
        return self.base("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("unit_price"),
        )

    def products(self) -> DataFrame:
        kind = F.col("p_type")
        return self.base("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            _case(
                kind, {"ECONOMY": "Electronics", "SMALL": "Home & Garden", "PROMO": "Clothing"}, kind
            ).alias("category"),
            (F.col("p_retailprice").cast(MONEY) * 110).cast(MONEY).alias("unit_price"),
            F.concat("p_brand", F.lit(" "), kind).alias("description"),
        )

    def employees(self) -> DataFrame:
        """A tree with three reports per manager."""
        key = F.col("c_custkey")
        manager = F.when(key == 0, None).otherwise(((key - 1 - (key - 1) % 3) / 3).cast("bigint"))
        return self.base("customer").select(
            key.alias("employee_id"),
            F.col("c_name").alias("employee_name"),
            manager.alias("manager_id"),
            F.col("c_nationkey").alias("department_id"),
        )

    def sales(self) -> DataFrame:
        """Sales; every 7th has no employee."""
        key = F.col("o_orderkey")
        return self.base("orders").select(
            key.alias("sale_id"),
            F.when(key % 7 == 0, None).otherwise(F.col("o_custkey")).alias("employee_id"),
            F.col("o_totalprice").cast(MONEY).alias("sales_amount"),
            F.col("o_orderdate").cast("date").alias("sale_date"),
        )

    def sales_transactions(self, since: dt.date | None = None) -> DataFrame:
        return self.base("orders").where(_days("o_orderdate", since, None)).select(
            F.col("o_orderkey").alias("sale_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast(MONEY).alias("sales_amount"),
            F.col("o_orderdate").cast("date").alias("sale_date"),
        )

    def regions(self) -> DataFrame:
        region = F.col("n_regionkey")
        return self.base("nation").select(
            F.col("n_nationkey").alias("region_id"),
            F.col("n_name").alias("region_name"),
            F.concat(F.lit("R"), region.cast("string")).alias("region_code"),
            F.when(region == 1, "US").otherwise("XX").alias("country_code"),
        )

    def store_master(self) -> DataFrame:
        return self.base("supplier").select(
            F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name")
        )

    def customers_staging(self) -> DataFrame:
        """Changes to customers: half of them known keys, half new ones."""
        key = F.col("c_custkey")
        return (
            self.base("customer")
            .where(key % 3 == 0)
            .select(
                F.when(key % 6 == 0, key).otherwise(key + 1000000).alias("customer_id"),
                F.concat("c_name", F.lit(" v2")).alias("customer_name"),
                F.concat(F.lit("s"), key.cast("string"), F.lit("@example.com")).alias("email"),
                F.lit("ACTIVE").alias("status"),
                F.lit("GOLD").alias("customer_tier"),
            )
        )
