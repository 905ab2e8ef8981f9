"""Oracle SQL of the workload queries."""

from __future__ import annotations

VIEWS = {
    "orders_v": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'OPEN' ELSE 'CANCELLED' END AS status
FROM orders""",
    "customers": """
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
  concat('c', CAST(c.c_custkey AS VARCHAR), '@example.com') AS email,
  CASE WHEN c.c_acctbal >= 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'PLATINUM' WHEN 'MACHINERY' THEN 'GOLD' WHEN 'FURNITURE' THEN 'SILVER' ELSE 'BRONZE' END AS customer_tier,
  CAST(concat(CAST(1994 + c.c_custkey % 3 AS VARCHAR), '-0', CAST(1 + c.c_custkey % 9 AS VARCHAR), '-15') AS DATE) AS registration_date,
  a.total_spent, a.last_order_date, coalesce(a.order_count, 0) AS order_count,
  c.c_nationkey AS region_id, c.c_custkey % 10 AS preferred_store_id,
  concat('{"email_opt_in":"', CASE WHEN c.c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, '","favorite_category":"', c.c_mktsegment, '","active":"', CASE WHEN c.c_custkey % 3 = 0 THEN 'false' ELSE 'true' END, '"}') AS preferences,
  concat('{"source":"src', CAST(c.c_custkey % 4 AS VARCHAR), '"}') AS metadata,
  concat('<customer><preferences><email_opt_in>', CASE WHEN c.c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, '</email_opt_in></preferences><address><city>City', CAST(c.c_nationkey AS VARCHAR), '</city><country>C', CAST(c.c_nationkey % 5 AS VARCHAR), '</country></address></customer>') AS customer_data,
  concat(lower(c.c_mktsegment), ',tag', CAST(c.c_custkey % 5 AS VARCHAR)) AS tags_csv
FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT s_suppkey + 10000000000, s_name, s_nationkey, s_acctbal, 'HOUSEHOLD' FROM supplier) c LEFT JOIN (SELECT customer_id, SUM(total_amount) AS total_spent, MAX(order_date) AS last_order_date, COUNT(*) AS order_count FROM orders_v GROUP BY customer_id) a ON c.c_custkey = a.customer_id""",
    "order_items": """
SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
  CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(15,2)) AS unit_price FROM lineitem""",
    "products": """
SELECT p_partkey AS product_id, p_name AS product_name,
  CASE p_type WHEN 'ECONOMY' THEN 'Electronics' WHEN 'SMALL' THEN 'Home & Garden' WHEN 'PROMO' THEN 'Clothing' ELSE p_type END AS category,
  CAST(CAST(p_retailprice AS DECIMAL(15,2)) * 110 AS DECIMAL(15,2)) AS unit_price, concat(p_brand, ' ', p_type) AS description FROM part""",
    "employees": """
SELECT c_custkey AS employee_id, c_name AS employee_name,
  CASE WHEN c_custkey = 0 THEN NULL ELSE CAST((c_custkey - 1 - (c_custkey - 1) % 3) / 3 AS BIGINT) END AS manager_id,
  c_nationkey AS department_id FROM customer""",
    "sales": """
SELECT o_orderkey AS sale_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS employee_id,
  CAST(o_totalprice AS DECIMAL(15,2)) AS sales_amount, CAST(o_orderdate AS DATE) AS sale_date FROM orders""",
    "sales_transactions": """
SELECT o_orderkey AS sale_id, o_custkey AS customer_id,
  CAST(o_totalprice AS DECIMAL(15,2)) AS sales_amount, CAST(o_orderdate AS DATE) AS sale_date FROM orders""",
    "regions": """
SELECT n_nationkey AS region_id, n_name AS region_name, concat('R', CAST(n_regionkey AS VARCHAR)) AS region_code,
  CASE WHEN n_regionkey = 1 THEN 'US' ELSE 'XX' END AS country_code FROM nation""",
    "store_master": "SELECT s_suppkey AS store_id, s_name AS store_name FROM supplier",
    "customers_staging": """
SELECT CASE WHEN c_custkey % 6 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS customer_id,
  concat(c_name, ' v2') AS customer_name, concat('s', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
  'ACTIVE' AS status, 'GOLD' AS customer_tier FROM customer WHERE c_custkey % 3 = 0""",
}
CTES = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items())

DATES = {
    "order_date", "registration_date", "last_order_date", "first_order_date", "sale_date",
    "report_date", "analysis_date", "last_processed_date", "cohort_month", "revenue_month",
    "report_timestamp",
}


def q(body: str, columns: str, extra: str = "") -> str:
    """Wrap a query: the views in front, money as DOUBLE and dates as text at the end.

    ``columns`` lists the output; a trailing ``$`` marks money.
    """
    out = []
    for name in columns.split():
        if name.endswith("$"):
            out.append(f"CAST({name[:-1]} AS DOUBLE) AS {name[:-1]}")
        elif name in DATES:
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        else:
            out.append(name)
    more = f",\n{extra}" if extra else ""
    return f"WITH RECURSIVE {CTES}{more}\nSELECT {', '.join(out)} FROM ({body}) AS result"


CUSTOMER = (
    "customer_id customer_name email status customer_tier registration_date total_spent$ "
    "last_order_date order_count region_id preferred_store_id preferences metadata customer_data tags_csv"
)

SQL = {
    "w0101_simple_select": q(
        "SELECT customer_id, customer_name, email FROM customers WHERE status = 'ACTIVE'",
        "customer_id customer_name email",
    ),
    "w0102_select_star": q(
        "SELECT * FROM customers WHERE registration_date >= DATE '1996-01-01'", CUSTOMER
    ),
    "w0103_inner_join": q(
        """SELECT c.customer_id, c.customer_name, o.order_id, o.order_date, o.total_amount
        FROM customers c JOIN orders_v o ON c.customer_id = o.customer_id
        WHERE o.order_date >= DATE '2000-01-01'""",
        "customer_id customer_name order_id order_date total_amount$",
    ),
    "w0104_left_join_agg": q(
        """SELECT c.customer_id, c.customer_name, COUNT(o.order_id) AS order_count, SUM(o.total_amount) AS total_spent
        FROM customers c LEFT JOIN orders_v o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.customer_name""",
        "customer_id customer_name order_count total_spent$",
    ),
    "w0105_right_join": q(
        """SELECT e.employee_id, e.employee_name, s.sale_id, s.sales_amount, s.sale_date
        FROM employees e RIGHT JOIN sales s ON e.employee_id = s.employee_id""",
        "employee_id employee_name sale_id sales_amount$ sale_date",
    ),
    "w0106_insert_select": q(
        """SELECT * FROM customers WHERE status = 'INACTIVE'
        UNION ALL SELECT * REPLACE (NULL AS email) FROM customers WHERE status = 'ACTIVE'""",
        "customer_id customer_name email total_spent$ order_count last_order_date",
    ),
    "w0107_ctas": q(
        """SELECT o.order_id, o.customer_id, o.order_date, oi.order_item_id, oi.product_id, p.product_name,
        oi.quantity, oi.unit_price, oi.quantity * oi.unit_price AS line_total
        FROM orders_v o JOIN order_items oi ON o.order_id = oi.order_id JOIN products p ON oi.product_id = p.product_id""",
        "order_id customer_id order_date order_item_id product_id product_name quantity unit_price$ line_total$",
    ),
    "w0108_create_view": q(
        """SELECT c.customer_id, c.customer_name, c.email, o.order_id, o.order_date, o.total_amount, o.status
        FROM customers c LEFT JOIN orders_v o ON c.customer_id = o.customer_id""",
        "customer_id customer_name email order_id order_date total_amount$ status",
    ),
    "w0109_union_all": q(
        """SELECT customer_id AS id, customer_name AS name, email, 'CUSTOMER' AS source_type FROM customers
        UNION ALL SELECT employee_id, employee_name, CAST(employee_id AS VARCHAR(100)), 'EMPLOYEE' FROM employees""",
        "id name email source_type",
    ),
    "w0110_update_join": q(
        """SELECT customer_id, customer_name, CASE WHEN EXISTS (SELECT 1 FROM orders_v o
        WHERE o.customer_id = c.customer_id AND o.total_amount > 400000) THEN 'GOLD' ELSE customer_tier END AS customer_tier
        FROM customers c""",
        "customer_id customer_name customer_tier",
    ),
    "w0111_delete_in": q(
        """SELECT customer_id, customer_name, status FROM customers
        WHERE customer_id NOT IN (SELECT customer_id FROM orders_v WHERE order_date < DATE '1996-01-01')""",
        "customer_id customer_name status",
    ),
    "w0112_union_distinct": q(
        """SELECT customer_id, customer_name FROM customers WHERE customer_tier = 'GOLD'
        UNION SELECT customer_id, customer_name FROM customers WHERE total_spent > 1500000""",
        "customer_id customer_name",
    ),
    "w0201_single_cte": q(
        "SELECT * FROM customers WHERE status = 'ACTIVE' AND total_spent > 30000",
        "customer_id customer_name email total_spent$",
    ),
    "w0202_dependent_ctes": q(
        """SELECT c.customer_id, c.customer_name, c.email, t.total_revenue, t.order_count FROM customers c
        JOIN (SELECT customer_id, SUM(total_amount) AS total_revenue, COUNT(*) AS order_count FROM orders_v GROUP BY customer_id) t
        ON c.customer_id = t.customer_id WHERE t.total_revenue > 150000""",
        "customer_id customer_name email total_revenue$ order_count",
    ),
    "w0203_nested_cte": q(
        """SELECT o.order_id, o.customer_id, o.order_date, a.item_count, a.order_total, a.products FROM orders_v o
        JOIN (SELECT oi.order_id, COUNT(*) AS item_count, SUM(oi.quantity * oi.unit_price) AS order_total,
              string_agg(p.product_name, ', ' ORDER BY p.product_name) AS products
              FROM order_items oi JOIN products p ON oi.product_id = p.product_id GROUP BY oi.order_id) a
        ON o.order_id = a.order_id WHERE a.order_total > 500""",
        "order_id customer_id order_date item_count order_total$ products",
    ),
    "w0204_recursive_cte": q(
        "SELECT * FROM hierarchy",
        "employee_id employee_name manager_id level hierarchy_path",
        """hierarchy AS (
        SELECT employee_id, employee_name, manager_id, CAST(1 AS BIGINT) AS level, CAST(employee_name AS VARCHAR) AS hierarchy_path
        FROM employees WHERE manager_id IS NULL
        UNION ALL
        SELECT e.employee_id, e.employee_name, e.manager_id, h.level + 1, h.hierarchy_path || ' > ' || e.employee_name
        FROM employees e JOIN hierarchy h ON e.manager_id = h.employee_id)""",
    ),
    "w0205_cte_insert": q(
        """SELECT customer_id, customer_name, order_count, total_spent, last_order_date, email FROM customers WHERE status = 'INACTIVE'
        UNION ALL SELECT c.customer_id, c.customer_name, COUNT(o.order_id) AS order_count, SUM(o.total_amount) AS total_spent,
        MAX(o.order_date) AS last_order_date, NULL FROM customers c LEFT JOIN orders_v o ON c.customer_id = o.customer_id
        GROUP BY c.customer_id, c.customer_name HAVING COUNT(o.order_id) > 0""",
        "customer_id customer_name order_count total_spent$ last_order_date email",
    ),
    "w0206_independent_ctes": q(
        """SELECT c.customer_id, c.customer_name, c.customer_tier, s.lifetime_orders, s.lifetime_value FROM customers c
        LEFT JOIN (SELECT customer_id, COUNT(*) AS lifetime_orders, SUM(total_amount) AS lifetime_value FROM orders_v GROUP BY customer_id) s
        ON c.customer_id = s.customer_id""",
        "customer_id customer_name customer_tier lifetime_orders lifetime_value$",
    ),
    "w0301_scalar_subquery": q(
        """SELECT c.customer_id, c.customer_name, c.email,
        (SELECT COUNT(*) FROM orders_v o WHERE o.customer_id = c.customer_id) AS order_count,
        (SELECT SUM(total_amount) FROM orders_v o WHERE o.customer_id = c.customer_id) AS total_spent
        FROM (SELECT customer_id, customer_name, email FROM customers WHERE status = 'ACTIVE') c""",
        "customer_id customer_name email order_count total_spent$",
    ),
    "w0302_in_subquery": q(
        """SELECT customer_id, customer_name, email, customer_tier FROM customers WHERE customer_id IN
        (SELECT customer_id FROM orders_v WHERE order_date >= DATE '2000-01-01' AND total_amount > 100000)""",
        "customer_id customer_name email customer_tier",
    ),
    "w0303_correlated_avg": q(
        """SELECT o.order_id, o.customer_id, o.order_date, o.total_amount FROM orders_v o
        JOIN (SELECT customer_id, CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS a FROM orders_v GROUP BY customer_id) g
        ON g.customer_id = o.customer_id WHERE CAST(o.total_amount AS DOUBLE) > g.a""",
        "order_id customer_id order_date total_amount$",
    ),
    "w0304_derived_table": q(
        """SELECT oa.customer_id, c.customer_name, oa.order_count, oa.total_revenue, oa.avg_order_value FROM
        (SELECT customer_id, COUNT(*) AS order_count, SUM(total_amount) AS total_revenue,
         CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value FROM orders_v
         WHERE order_date >= DATE '2000-01-01' GROUP BY customer_id) oa JOIN customers c ON oa.customer_id = c.customer_id""",
        "customer_id customer_name order_count total_revenue$ avg_order_value",
    ),
    "w0305_nested_in": q(
        """SELECT customer_id, customer_name, email FROM customers WHERE customer_id IN (SELECT customer_id FROM orders_v WHERE order_id IN
        (SELECT order_id FROM order_items WHERE product_id IN (SELECT product_id FROM products WHERE category = 'Electronics')))""",
        "customer_id customer_name email",
    ),
    "w0306_exists": q(
        """SELECT c.customer_id, c.customer_name, c.email, c.customer_tier FROM customers c WHERE EXISTS (SELECT 1 FROM orders_v o
        WHERE o.customer_id = c.customer_id AND o.order_date >= DATE '2000-01-01' AND o.total_amount > 250000)""",
        "customer_id customer_name email customer_tier",
    ),
    "w0307_not_exists": q(
        """SELECT c.customer_id, c.customer_name, c.email, c.last_order_date FROM customers c WHERE NOT EXISTS (SELECT 1 FROM orders_v o
        WHERE o.customer_id = c.customer_id AND o.order_date >= DATE '2000-06-01')""",
        "customer_id customer_name email last_order_date",
    ),
    "w0308_gt_all": q(
        """SELECT p.product_id, p.product_name, p.category, p.unit_price FROM products p WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT product_id, order_id, CAST(SUM(unit_price) AS DOUBLE) / COUNT(*) AS a FROM order_items GROUP BY product_id, order_id) g
        WHERE g.product_id = p.product_id AND (g.a IS NULL OR CAST(p.unit_price AS DOUBLE) <= g.a))""",
        "product_id product_name category unit_price$",
    ),
    "w0401_merge": q(
        """SELECT coalesce(t.customer_id, s.customer_id) AS customer_id,
        CASE WHEN s.customer_id IS NOT NULL THEN s.customer_name ELSE t.customer_name END AS customer_name,
        CASE WHEN s.customer_id IS NOT NULL THEN s.email ELSE t.email END AS email,
        CASE WHEN t.customer_id IS NULL THEN s.status ELSE t.status END AS status,
        CASE WHEN s.customer_id IS NOT NULL THEN s.customer_tier ELSE t.customer_tier END AS customer_tier,
        t.registration_date FROM customers t FULL OUTER JOIN customers_staging s ON t.customer_id = s.customer_id""",
        "customer_id customer_name email status customer_tier registration_date",
    ),
    "w0402_row_number_qualify": q(
        """SELECT order_id, customer_id, order_date, total_amount,
        ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id) AS order_sequence
        FROM orders_v QUALIFY order_sequence <= 5""",
        "order_id customer_id order_date total_amount$ order_sequence",
    ),
    "w0403_rank_ntile": q(
        """SELECT customer_id, customer_name, total_spent,
        RANK() OVER (ORDER BY total_spent DESC NULLS LAST) AS spending_rank,
        DENSE_RANK() OVER (ORDER BY total_spent DESC NULLS LAST) AS dense_spending_rank,
        NTILE(10) OVER (ORDER BY total_spent DESC NULLS LAST, customer_id) AS spending_decile
        FROM customers WHERE status = 'ACTIVE'""",
        "customer_id customer_name total_spent$ spending_rank dense_spending_rank spending_decile",
    ),
    "w0404_lag_lead": q(
        """SELECT order_id, customer_id, order_date, total_amount,
        LAG(total_amount, 1) OVER w AS previous_order_amount, LEAD(total_amount, 1) OVER w AS next_order_amount,
        total_amount - LAG(total_amount, 1, 0) OVER w AS amount_change
        FROM orders_v WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)""",
        "order_id customer_id order_date total_amount$ previous_order_amount$ next_order_amount$ amount_change$",
    ),
    "w0405_case": q(
        """SELECT customer_id, customer_name, total_spent, order_count,
        CASE WHEN total_spent > 3000000 THEN 'PLATINUM' WHEN total_spent > 2500000 THEN 'GOLD' WHEN total_spent > 1750000 THEN 'SILVER' ELSE 'BRONZE' END AS customer_tier,
        CASE WHEN order_count = 0 THEN 'NEVER_ORDERED' WHEN last_order_date < DATE '2001-08-01' - INTERVAL 90 DAY THEN 'DORMANT'
             WHEN last_order_date < DATE '2001-08-01' - INTERVAL 30 DAY THEN 'AT_RISK' ELSE 'ACTIVE' END AS customer_status,
        CASE WHEN order_count > 0 THEN CAST(total_spent AS DOUBLE) / order_count ELSE 0 END AS avg_order_value FROM customers""",
        "customer_id customer_name total_spent$ order_count customer_tier customer_status avg_order_value",
    ),
    "w0406_qualify_join": q(
        """SELECT c.customer_id, c.customer_name, o.order_id, o.order_date, o.total_amount,
        ROW_NUMBER() OVER (PARTITION BY c.customer_id ORDER BY o.total_amount DESC, o.order_id) AS order_rank
        FROM customers c JOIN orders_v o ON c.customer_id = o.customer_id QUALIFY order_rank = 1""",
        "customer_id customer_name order_id order_date total_amount$ order_rank",
    ),
    "w0407_insert_positional": q(
        """SELECT customer_id, email AS customer_name, customer_tier AS status, customer_name AS email, status AS customer_tier
        FROM customers WHERE status = 'INACTIVE'
        UNION ALL SELECT customer_id, customer_name, status, email, customer_tier FROM customers WHERE customer_tier = 'PLATINUM'""",
        "customer_id customer_name status email customer_tier",
    ),
    "w0408_pivot": q(
        """SELECT customer_id, SUM(total_amount) FILTER (year(order_date) = 1998) AS spend_1998,
        SUM(total_amount) FILTER (year(order_date) = 1999) AS spend_1999, SUM(total_amount) FILTER (year(order_date) = 2000) AS spend_2000
        FROM orders_v GROUP BY customer_id""",
        "customer_id spend_1998$ spend_1999$ spend_2000$",
    ),
    "w0501_proc_insert": q(
        """SELECT customer_id, customer_name, total_spent, order_count, last_order_date,
        CASE WHEN status = 'INACTIVE' THEN email END AS email FROM customers""",
        "customer_id customer_name email total_spent$ order_count last_order_date",
    ),
    "w0502_proc_pipeline": q(
        """SELECT c.customer_id, c.order_count + coalesce(d.n, 0) AS order_count,
        CASE WHEN d.customer_id IS NULL THEN c.total_spent ELSE c.total_spent + d.amount END AS total_spent
        FROM customers c LEFT JOIN (SELECT customer_id, COUNT(*) AS n, SUM(total_amount) AS amount FROM orders_v
        WHERE order_date >= DATE '2001-08-01' - INTERVAL 30 DAY GROUP BY customer_id) d ON c.customer_id = d.customer_id""",
        "customer_id order_count total_spent$",
    ),
    "w0503_proc_if": q(
        """SELECT customer_id, customer_name, CASE WHEN customer_id <> 7 THEN customer_tier
        WHEN total_spent > 3000000 THEN 'PLATINUM' WHEN total_spent > 1500000 THEN 'GOLD' ELSE 'SILVER' END AS customer_tier FROM customers""",
        "customer_id customer_name customer_tier",
    ),
    "w0504_dynamic_table": q(
        "SELECT * FROM customers", "customer_id customer_name total_spent$"
    ),
    "w0505_macro": q(
        """SELECT o.order_id, o.order_date, o.total_amount, o.status, c.customer_name, c.email
        FROM orders_v o JOIN customers c ON o.customer_id = c.customer_id WHERE o.customer_id = 7""",
        "order_id order_date total_amount$ status customer_name email",
    ),
    "w0506_cursor_loop": q(
        """SELECT customer_id, customer_name, CASE WHEN status = 'ACTIVE' THEN DATE '2001-08-01' END AS last_processed_date FROM customers""",
        "customer_id customer_name last_processed_date",
    ),
    "w0601_three_part": q(
        """SELECT c.customer_id, c.customer_name, o.order_id, o.order_date, o.total_amount, 'Archive' AS schema_name
        FROM customers c JOIN orders_v o ON c.customer_id = o.customer_id WHERE o.order_date >= DATE '2000-01-01'
        UNION ALL SELECT c.customer_id, c.customer_name, o.order_id, o.order_date, o.total_amount, 'Analytics'
        FROM customers c JOIN orders_v o ON c.customer_id = o.customer_id
        WHERE o.order_date >= DATE '1996-01-01' AND o.order_date < DATE '1998-01-01'""",
        "customer_id customer_name order_id order_date total_amount$ schema_name",
    ),
    "w0602_mixed_names": q(
        """SELECT c.customer_id, c.customer_name, o.order_id, o.total_amount, p.product_name, s.schema_name FROM customers c
        JOIN orders_v o ON c.customer_id = o.customer_id JOIN order_items oi ON o.order_id = oi.order_id
        JOIN products p ON oi.product_id = p.product_id
        JOIN (VALUES ('Analytics'), ('Archive')) AS s(schema_name) ON s.schema_name = 'Analytics' OR p.category = 'Electronics'""",
        "customer_id customer_name order_id total_amount$ product_name schema_name",
    ),
    "w0603_cross_schema": q(
        """SELECT c.customer_id, c.customer_name, c.email, s.sale_id, s.sales_amount, s.sale_date FROM customers c
        JOIN sales_transactions s ON c.customer_id = s.customer_id WHERE s.sale_date >= DATE '2000-01-01'""",
        "customer_id customer_name email sale_id sales_amount$ sale_date",
    ),
    "w0604_cross_database": q(
        """SELECT c.customer_id, c.customer_name, c.email, r.region_name, r.region_code, s.store_name FROM customers c
        JOIN regions r ON c.region_id = r.region_id JOIN store_master s ON c.preferred_store_id = s.store_id WHERE c.status = 'ACTIVE'""",
        "customer_id customer_name email region_name region_code store_name",
    ),
    "w0605_default_schema": q(
        """SELECT *, 'Analytics' AS schema_name FROM customers WHERE status = 'ACTIVE' AND total_spent > 300000
        UNION ALL SELECT c.* REPLACE (o.spent AS total_spent, o.n AS order_count), 'Archive' FROM customers c
        JOIN (SELECT customer_id, SUM(total_amount) AS spent, COUNT(*) AS n FROM orders_v WHERE order_date < DATE '1998-01-01'
        GROUP BY customer_id) o ON c.customer_id = o.customer_id WHERE c.status = 'ACTIVE' AND o.spent > 300000""",
        "customer_id customer_name email total_spent$ order_count schema_name",
    ),
    "w0606_cross_db_cte": q(
        """SELECT rc.customer_id, rc.customer_name, rc.region_name, co.order_count, co.total_revenue FROM
        (SELECT c.customer_id, c.customer_name, r.region_name FROM customers c JOIN regions r ON c.region_id = r.region_id WHERE r.country_code = 'US') rc
        LEFT JOIN (SELECT customer_id, COUNT(*) AS order_count, SUM(total_amount) AS total_revenue FROM orders_v GROUP BY customer_id) co
        ON rc.customer_id = co.customer_id""",
        "customer_id customer_name region_name order_count total_revenue$",
    ),
    "w0701_json": q(
        """SELECT customer_id, customer_name, preferences ->> '$.email_opt_in' AS email_opt_in,
        preferences ->> '$.favorite_category' AS favorite_category, metadata ->> '$.source' AS data_source
        FROM customers WHERE (preferences ->> '$.active') = 'true'""",
        "customer_id customer_name email_opt_in favorite_category data_source",
    ),
    "w0702_unnest": q(
        "SELECT customer_id, customer_name, unnest(string_split(tags_csv, ',')) AS tag_value FROM customers WHERE status = 'ACTIVE'",
        "customer_id customer_name tag_value",
    ),
    "w0703_wide_query": q(
        """SELECT c.customer_id, c.customer_name, c.email, c.status, c.customer_tier, c.registration_date, c.total_spent,
        c.last_order_date, c.order_count, o.order_id, o.order_date, o.total_amount AS order_total, o.status AS order_status,
        oi.order_item_id, oi.quantity, oi.unit_price, oi.quantity * oi.unit_price AS line_item_total,
        p.product_id, p.product_name, p.category, p.description, p.unit_price AS product_unit_price,
        CASE c.customer_tier WHEN 'PLATINUM' THEN oi.quantity * oi.unit_price * 0.80 WHEN 'GOLD' THEN oi.quantity * oi.unit_price * 0.85
          WHEN 'SILVER' THEN oi.quantity * oi.unit_price * 0.90 ELSE oi.quantity * oi.unit_price END AS discounted_total,
        DATE '2001-08-01' AS report_date, TIMESTAMP '2001-08-01 00:00:00' AS report_timestamp,
        EXTRACT(YEAR FROM o.order_date) AS order_year, EXTRACT(MONTH FROM o.order_date) AS order_month, EXTRACT(DAY FROM o.order_date) AS order_day,
        dayofweek(o.order_date) + 1 AS order_day_of_week, date_diff('day', o.order_date, DATE '2001-08-01') AS days_since_order,
        ROW_NUMBER() OVER (PARTITION BY c.customer_id ORDER BY o.order_date DESC, oi.order_item_id, oi.product_id, oi.quantity, oi.unit_price) AS customer_order_seq,
        RANK() OVER (PARTITION BY p.category ORDER BY oi.quantity * oi.unit_price DESC) AS category_sales_rank,
        SUM(oi.quantity * oi.unit_price) OVER (PARTITION BY c.customer_id) AS customer_total_value,
        CAST(SUM(oi.quantity * oi.unit_price) OVER (PARTITION BY c.customer_id) AS DOUBLE) / COUNT(*) OVER (PARTITION BY c.customer_id) AS customer_avg_line_value,
        COUNT(*) OVER (PARTITION BY c.customer_id) AS customer_line_count
        FROM customers c JOIN orders_v o ON c.customer_id = o.customer_id JOIN order_items oi ON o.order_id = oi.order_id
        JOIN products p ON oi.product_id = p.product_id
        WHERE c.status = 'ACTIVE' AND o.order_date >= DATE '2000-01-01' AND p.category IN ('Electronics', 'Home & Garden', 'Clothing')""",
        "customer_id customer_name email status customer_tier registration_date total_spent$ last_order_date order_count order_id "
        "order_date order_total$ order_status order_item_id quantity unit_price$ line_item_total$ product_id product_name category "
        "description product_unit_price$ discounted_total$ report_date report_timestamp order_year order_month order_day "
        "order_day_of_week days_since_order customer_order_seq category_sales_rank customer_total_value$ customer_avg_line_value customer_line_count",
    ),
    "w0704_deep_nesting": q(
        """SELECT * FROM (SELECT c.customer_id, c.customer_name, SUM(o.total_amount) AS total_order_value FROM customers c
        LEFT JOIN orders_v o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.customer_name)
        WHERE total_order_value > 30000 AND customer_name IS NOT NULL AND total_order_value < 3000000""",
        "customer_id customer_name total_order_value$",
    ),
    "w0705_identifier": q(
        "SELECT * FROM customers WHERE status = 'ACTIVE'", "customer_id customer_name total_spent$"
    ),
    "w0706_xml": q(
        """SELECT customer_id, customer_name, regexp_extract(customer_data, '<email_opt_in>([^<]*)<', 1) AS email_opt_in,
        regexp_extract(customer_data, '<city>([^<]*)<', 1) AS city, regexp_extract(customer_data, '<country>([^<]*)<', 1) AS country
        FROM customers WHERE customer_data LIKE '%<email_opt_in>true</email_opt_in>%'""",
        "customer_id customer_name email_opt_in city country",
    ),
    "w0707_lateral_topk": q(
        """SELECT c.customer_id, c.customer_name, o.order_id, o.order_date, o.total_amount FROM
        (SELECT customer_id, customer_name FROM customers WHERE status = 'ACTIVE') c, LATERAL (SELECT order_id, order_date, total_amount FROM orders_v o
        WHERE o.customer_id = c.customer_id ORDER BY order_date DESC, order_id LIMIT 5) o""",
        "customer_id customer_name order_id order_date total_amount$",
    ),
    "w0708_table_function": q(
        """SELECT * FROM (SELECT s.customer_id, c.customer_name,
        CASE WHEN s.score > 95 THEN 'TOP' WHEN s.score > 80 THEN 'HIGH' WHEN s.score > 40 THEN 'MIDDLE' ELSE 'LOW' END AS segment_name,
        s.score AS segment_score FROM (SELECT customer_id, round(percent_rank() OVER (ORDER BY SUM(total_amount)) * 100, 6) AS score
        FROM orders_v WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY customer_id) s
        JOIN customers c ON c.customer_id = s.customer_id) WHERE segment_score > 80""",
        "customer_id customer_name segment_name segment_score",
    ),
    "w0801_customer_360": q(
        """SELECT c.customer_id, c.customer_name, c.email, c.status, c.customer_tier, c.registration_date, h.total_orders, h.lifetime_value,
        h.avg_order_value, h.first_order_date, h.last_order_date, h.customer_lifetime_days,
        coalesce(r.orders_last_90_days, 0) AS orders_last_90_days, coalesce(r.spend_last_90_days, 0) AS spend_last_90_days,
        p.preferred_category, p.category_spend AS preferred_category_spend,
        CASE WHEN h.last_order_date >= DATE '2001-08-01' - INTERVAL 30 DAY THEN 'ACTIVE' WHEN h.last_order_date >= DATE '2001-08-01' - INTERVAL 90 DAY THEN 'AT_RISK'
          WHEN h.last_order_date >= DATE '2001-08-01' - INTERVAL 180 DAY THEN 'DORMANT' ELSE 'LOST' END AS engagement_status,
        CASE WHEN h.customer_lifetime_days > 0 THEN CAST(h.lifetime_value AS DOUBLE) / h.customer_lifetime_days ELSE 0 END AS daily_value_rate
        FROM (SELECT customer_id, customer_name, email, status, customer_tier, registration_date FROM customers WHERE status = 'ACTIVE') c
        LEFT JOIN (SELECT customer_id, COUNT(DISTINCT order_id) AS total_orders, SUM(total_amount) AS lifetime_value,
          CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value, MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
          date_diff('day', MIN(order_date), MAX(order_date)) AS customer_lifetime_days
          FROM orders_v WHERE status NOT IN ('CANCELLED', 'REFUNDED') GROUP BY customer_id) h ON c.customer_id = h.customer_id
        LEFT JOIN (SELECT customer_id, COUNT(DISTINCT order_id) AS orders_last_90_days, SUM(total_amount) AS spend_last_90_days
          FROM orders_v WHERE order_date >= DATE '2001-08-01' - INTERVAL 90 DAY GROUP BY customer_id) r ON c.customer_id = r.customer_id
        LEFT JOIN (SELECT o.customer_id, p.category AS preferred_category, SUM(oi.quantity * oi.unit_price) AS category_spend
          FROM orders_v o JOIN order_items oi ON o.order_id = oi.order_id JOIN products p ON oi.product_id = p.product_id GROUP BY o.customer_id, p.category
          QUALIFY ROW_NUMBER() OVER (PARTITION BY o.customer_id ORDER BY SUM(oi.quantity * oi.unit_price) DESC, p.category) = 1) p
        ON c.customer_id = p.customer_id""",
        "customer_id customer_name email status customer_tier registration_date total_orders lifetime_value$ avg_order_value "
        "first_order_date last_order_date customer_lifetime_days orders_last_90_days spend_last_90_days$ preferred_category "
        "preferred_category_spend$ engagement_status daily_value_rate",
    ),
    "w0802_sales_dashboard": q(
        """SELECT d.*, RANK() OVER (PARTITION BY d.report_date ORDER BY d.total_revenue DESC) AS revenue_rank,
        CASE WHEN t.day_total > 0 THEN CAST(d.total_revenue AS DOUBLE) / CAST(t.day_total AS DOUBLE) * 100 ELSE 0 END AS revenue_pct_of_total
        FROM daily d JOIN (SELECT report_date, SUM(total_revenue) AS day_total FROM daily GROUP BY report_date) t ON d.report_date = t.report_date""",
        "report_date product_category total_orders total_revenue$ total_units_sold avg_order_value unique_customers revenue_rank revenue_pct_of_total",
        """daily AS (SELECT o.order_date AS report_date, p.category AS product_category, COUNT(DISTINCT o.order_id) AS total_orders,
        SUM(oi.quantity * oi.unit_price) AS total_revenue, CAST(SUM(oi.quantity) AS BIGINT) AS total_units_sold,
        CAST(SUM(o.total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value, COUNT(DISTINCT o.customer_id) AS unique_customers
        FROM orders_v o JOIN order_items oi ON o.order_id = oi.order_id JOIN products p ON oi.product_id = p.product_id
        WHERE o.status = 'COMPLETED' AND o.order_date >= DATE '2001-08-01' - INTERVAL 14 DAY GROUP BY o.order_date, p.category)""",
    ),
    "w0803_churn": q(
        """SELECT cm.*, o.* EXCLUDE (customer_id),
        CASE WHEN idle > 180 THEN 'HIGH' WHEN idle > 90 THEN 'MEDIUM' WHEN idle > 60 THEN 'LOW' ELSE 'MINIMAL' END AS recency_risk,
        CASE WHEN n1 = 0 AND n2 > 0 THEN 'HIGH' WHEN n1 < n2 THEN 'MEDIUM' WHEN n1 = n2 THEN 'LOW' ELSE 'MINIMAL' END AS frequency_risk,
        CASE WHEN s1 = 0 AND s2 > 0 THEN 'HIGH' WHEN s1 < s2 * 0.5 THEN 'MEDIUM' WHEN s1 < s2 THEN 'LOW' ELSE 'MINIMAL' END AS monetary_risk,
        CAST(CASE WHEN idle > 180 THEN 40 WHEN idle > 90 THEN 25 WHEN idle > 60 THEN 10 ELSE 0 END
          + CASE WHEN n1 = 0 AND n2 > 0 THEN 30 WHEN n1 < n2 THEN 20 WHEN n1 = n2 THEN 10 ELSE 0 END
          + CASE WHEN s1 = 0 AND s2 > 0 THEN 30 WHEN s1 < s2 * 0.5 THEN 20 WHEN s1 < s2 THEN 10 ELSE 0 END AS BIGINT) AS churn_risk_score,
        DATE '2001-08-01' AS analysis_date, idle AS days_since_last_order, n1 AS orders_last_90_days, n2 AS orders_90_to_180_days,
        s1 AS spend_last_90_days, s2 AS spend_90_to_180_days
        FROM (SELECT customer_id, customer_name, email, customer_tier, total_spent AS lifetime_value, last_order_date, order_count,
          date_diff('day', last_order_date, DATE '2001-08-01') AS idle,
          CASE WHEN order_count > 0 THEN CAST(date_diff('day', registration_date, last_order_date) AS DOUBLE) / order_count END AS avg_days_between_orders
          FROM customers WHERE status = 'ACTIVE') cm
        LEFT JOIN (SELECT customer_id,
          COUNT(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 90 DAY THEN 1 END) AS n1,
          COUNT(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 180 DAY AND order_date < DATE '2001-08-01' - INTERVAL 90 DAY THEN 1 END) AS n2,
          SUM(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 90 DAY THEN total_amount ELSE 0 END) AS s1,
          SUM(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 180 DAY AND order_date < DATE '2001-08-01' - INTERVAL 90 DAY THEN total_amount ELSE 0 END) AS s2
          FROM orders_v WHERE status = 'COMPLETED' GROUP BY customer_id) o ON cm.customer_id = o.customer_id
        WHERE cm.lifetime_value > 20000""",
        "customer_id customer_name email customer_tier lifetime_value$ last_order_date order_count days_since_last_order avg_days_between_orders "
        "orders_last_90_days orders_90_to_180_days spend_last_90_days$ spend_90_to_180_days$ recency_risk frequency_risk monetary_risk churn_risk_score analysis_date",
    ),
    "w0804_inventory": q(
        """SELECT p.product_id, p.product_name, p.category, p.unit_price, v.*  EXCLUDE (product_id),
        v.daily AS daily_sales_velocity,
        CASE WHEN v.units_sold_7d > v.units_sold_8_14d THEN 'ACCELERATING' WHEN v.units_sold_7d < v.units_sold_8_14d * 0.8 THEN 'DECELERATING' ELSE 'STABLE' END AS trend_direction,
        CAST(trunc(round(v.daily * 14 + 2 * coalesce(v.sd, 0), 6)) AS BIGINT) AS recommended_reorder_point,
        CAST(trunc(round(v.daily * 30, 6)) AS BIGINT) AS recommended_order_quantity,
        round(v.sd, 6) AS stddev_units_per_order, DATE '2001-08-01' AS analysis_date
        FROM products p JOIN (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units_sold_30d, COUNT(DISTINCT order_id) AS order_frequency_30d,
          CAST(SUM(quantity) AS DOUBLE) / COUNT(*) AS avg_units_per_order, stddev_samp(quantity) AS sd, COUNT(DISTINCT order_date) AS days_with_sales,
          CAST(SUM(quantity) AS DOUBLE) / COUNT(DISTINCT order_date) AS daily,
          CAST(SUM(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 7 DAY THEN quantity ELSE 0 END) AS BIGINT) AS units_sold_7d,
          CAST(SUM(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 14 DAY AND order_date < DATE '2001-08-01' - INTERVAL 7 DAY THEN quantity ELSE 0 END) AS BIGINT) AS units_sold_8_14d,
          CAST(SUM(CASE WHEN order_date >= DATE '2001-08-01' - INTERVAL 30 DAY AND order_date < DATE '2001-08-01' - INTERVAL 14 DAY THEN quantity ELSE 0 END) AS BIGINT) AS units_sold_15_30d
          FROM order_items JOIN orders_v USING (order_id) WHERE order_date >= DATE '2001-08-01' - INTERVAL 30 DAY AND status = 'COMPLETED' GROUP BY product_id) v
        ON p.product_id = v.product_id WHERE v.units_sold_30d > 0""",
        "product_id product_name category unit_price$ units_sold_30d order_frequency_30d avg_units_per_order stddev_units_per_order days_with_sales "
        "units_sold_7d units_sold_8_14d units_sold_15_30d daily_sales_velocity trend_direction recommended_reorder_point recommended_order_quantity analysis_date",
    ),
    "w0805_cohort": q(
        """SELECT r.cohort_month, s.cohort_size, r.months_since_acquisition, r.revenue_month, r.active_customers, r.total_orders, r.total_revenue, r.avg_order_value,
        CAST((20000 * r.active_customers + s.cohort_size) // (2 * s.cohort_size) AS DOUBLE) / 100 AS customer_retention_pct,
        CAST((2 * r.cents + s.cohort_size) // (2 * s.cohort_size) AS DOUBLE) / 100 AS revenue_per_cohort_customer,
        SUM(r.total_revenue) OVER w AS cumulative_cohort_revenue, CAST(SUM(r.active_customers) OVER w AS BIGINT) AS cumulative_active_customers,
        LAG(r.total_revenue) OVER o AS prev_month_revenue,
        CASE WHEN LAG(r.cents) OVER o > 0 THEN CAST(sign(r.cents - LAG(r.cents) OVER o) AS DOUBLE)
          * CAST((20000 * abs(r.cents - LAG(r.cents) OVER o) + LAG(r.cents) OVER o) // (2 * LAG(r.cents) OVER o) AS DOUBLE) / 100 END AS revenue_growth_pct
        FROM (SELECT m.cohort_month, date_trunc('month', o.order_date) AS revenue_month,
          date_diff('month', CAST(m.cohort_month AS DATE), CAST(date_trunc('month', o.order_date) AS DATE)) AS months_since_acquisition,
          COUNT(DISTINCT m.customer_id) AS active_customers, COUNT(DISTINCT o.order_id) AS total_orders, SUM(o.total_amount) AS total_revenue,
          CAST(SUM(o.total_amount) * 100 AS HUGEINT) AS cents,  -- ties at the cent are exact in whole numbers
          CAST(SUM(o.total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value
          FROM members m JOIN orders_v o ON m.customer_id = o.customer_id WHERE o.status = 'COMPLETED' GROUP BY ALL) r
        JOIN (SELECT cohort_month, COUNT(DISTINCT customer_id) AS cohort_size FROM members GROUP BY cohort_month) s ON r.cohort_month = s.cohort_month
        WINDOW o AS (PARTITION BY r.cohort_month ORDER BY r.months_since_acquisition),
          w AS (PARTITION BY r.cohort_month ORDER BY r.months_since_acquisition ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "cohort_month cohort_size months_since_acquisition revenue_month active_customers total_orders total_revenue$ avg_order_value "
        "customer_retention_pct$ revenue_per_cohort_customer$ cumulative_cohort_revenue$ cumulative_active_customers prev_month_revenue$ revenue_growth_pct$",
        """members AS (SELECT customer_id, date_trunc('month', registration_date) AS cohort_month FROM customers WHERE registration_date >= DATE '1995-01-01')""",
    ),
}
# date_trunc may give a timestamp; the month is a date.
SQL["w0805_cohort"] = SQL["w0805_cohort"].replace(
    "CAST(cohort_month AS VARCHAR)", "CAST(CAST(cohort_month AS DATE) AS VARCHAR)"
).replace("CAST(revenue_month AS VARCHAR)", "CAST(CAST(revenue_month AS DATE) AS VARCHAR)")
