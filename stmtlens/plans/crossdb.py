"""Queries over several schemas, whose names are resolved by the session catalogue."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlens.plans import basic
from stmtlens.sources.namespaces import Namespaces
from stmtlens.sources.workload import Workload

DATABASE, CURRENT, ARCHIVE = "SampleDB", "Analytics", "Archive"


def _schemas(folder: str) -> dict[str, dict[str, str]]:
    """Views of two schemas with the same names: all rows, and those that have been put away."""
    scan = lambda name: f"parquet.`{folder}/{name}.parquet`"
    orders = f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
        o_orderdate AS ordered_at, CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount FROM {scan('orders')}"""
    people = f"""SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal FROM {scan('customer')}
        UNION ALL SELECT s_suppkey + 10000000000, s_name, s_acctbal FROM {scan('supplier')}"""
    customers = f"""SELECT c.customer_id, c.customer_name, concat('c', c.customer_id, '@example.com') AS email,
        CASE WHEN c.c_acctbal >= 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, s.total_spent,
        coalesce(s.order_count, 0) AS order_count
        FROM ({people}) c LEFT JOIN (SELECT customer_id, sum(total_amount) AS total_spent, count(*) AS order_count
        FROM orders GROUP BY customer_id) s ON c.customer_id = s.customer_id"""
    items = f"""SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
        l_partkey AS product_id FROM {scan('lineitem')}"""
    products = f"SELECT p_partkey AS product_id, p_name AS product_name, p_type FROM {scan('part')}"
    return {
        CURRENT: {"orders": orders, "customers": customers, "order_items": items, "products": products},
        ARCHIVE: {
            "orders": f"SELECT * FROM ({orders}) WHERE ordered_at < TIMESTAMP_NTZ '1998-01-01 00:00:00'",
            "customers": customers,
            "order_items": items,
            "products": f"SELECT * FROM ({products}) WHERE p_type = 'ECONOMY'",
        },
    }


def namespaces(w: Workload) -> Namespaces:
    """Both schemas over the tables of the workload's folder."""
    prefix = f"stmtlens_{zlib.crc32(w.folder.encode()):08x}"
    names = Namespaces(w.spark, prefix, DATABASE, CURRENT)
    for schema, views in _schemas(w.folder).items():
        names.create(DATABASE, schema, views)
    return names


def _in_both(names: Namespaces, query) -> DataFrame:
    """Rows of a query under either schema, with its name."""
    parts = []
    for schema in (CURRENT, ARCHIVE):
        with names.using(DATABASE, schema):
            parts.append(query(schema).withColumn("schema_name", F.lit(schema)))
    return parts[0].unionByName(parts[1])


# Rows of the large side of a join that one task sorts.
TASK_ROWS = 1_000_000


def _dealt(small: DataFrame, key: str, rows: int) -> DataFrame:
    """The small side of a join with ``rows`` others, cut so finely that a task sorts few of them.

    If the join shuffles, the other side takes over this number of partitions; if ``small`` is
    broadcast, the other side does not move. Few rows keep the number of the session.
    """
    tasks = -(-rows // TASK_ROWS)
    default = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.repartition(tasks, key) if tasks > default else small


def three_part(w: Workload) -> DataFrame:
    """Whole names: the default schema, which is the other one each time, plays no part."""
    names = namespaces(w)

    def joined(default: str) -> DataFrame:
        told = ARCHIVE if default == CURRENT else CURRENT
        every = names.table(f"{DATABASE}.{told}.orders").count()
        customers = _dealt(names.table(f"{DATABASE}.{told}.customers"), "customer_id", every)
        orders = names.table(f'"{DATABASE}".{told}.ORDERS').where(
            F.col("ordered_at") >= F.lit(basic.ORDERS_SINCE if told == CURRENT else basic.OLD_ORDERS_BEFORE)
            .cast("timestamp_ntz")
        )
        return customers.join(orders, "customer_id").select(
            "customer_id", "customer_name", "order_id", "order_date", "total_amount"
        )

    return _in_both(names, joined)


def mixed_names(w: Workload) -> DataFrame:
    """Bare names are looked up in the default schema, whole ones where they say.

    All joins carry the rows of the order items, and both schemas are joined in the same tasks.
    """
    names = namespaces(w)
    items = names.table("SampleDB.Analytics.order_items")
    rows = items.count()

    def joined(default: str) -> DataFrame:
        orders = names.table("SampleDB.Analytics.orders")
        return (
            items.join(_dealt(orders, "order_id", rows), "order_id")
            .join(_dealt(names.table("customers"), "customer_id", rows), "customer_id")
            .join(_dealt(names.table("products"), "product_id", rows), "product_id")
            .select("customer_id", "customer_name", "order_id", "total_amount", "product_name")
        )

    return _in_both(names, joined)


def cross_schema(w: Workload) -> DataFrame:
    recent = w.sales_transactions(since=basic.ORDERS_SINCE)
    return (
        w.customers()
        .join(recent, "customer_id")
        .select("customer_id", "customer_name", "email", "sale_id", "sales_amount", "sale_date")
    )


def cross_database(w: Workload) -> DataFrame:
    """Two dimension joins; their measured size decides between broadcast and shuffle."""
    return (
        w.customers()
        .where(F.col("status") == "ACTIVE")
        .join(w.regions(), "region_id")
        .join(w.store_master(), F.col("preferred_store_id") == F.col("store_id"))
        .select(
            "customer_id", "customer_name", "email", "region_name", "region_code", "store_name"
        )
    )


def default_schema(w: Workload) -> DataFrame:
    """One text of SQL with a bare name, run under either schema."""
    names = namespaces(w)
    text = """SELECT customer_id, customer_name, email, total_spent, order_count FROM customers
        WHERE status = 'ACTIVE' AND total_spent > 300000"""
    return _in_both(names, lambda default: w.spark.sql(text))


def cross_db_cte(w: Workload) -> DataFrame:
    regional = (
        w.customers()
        .join(w.regions().where(F.col("country_code") == "US"), "region_id")
        .select("customer_id", "customer_name", "region_name")
    )
    totals = w.orders().groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("total_amount").alias("total_revenue")
    )
    return regional.join(totals, "customer_id", "left").select(
        "customer_id", "customer_name", "region_name", "order_count", "total_revenue"
    )


QUERIES = {
    "w0601_three_part": three_part,
    "w0602_mixed_names": mixed_names,
    "w0603_cross_schema": cross_schema,
    "w0604_cross_database": cross_database,
    "w0605_default_schema": default_schema,
    "w0606_cross_db_cte": cross_db_cte,
}
