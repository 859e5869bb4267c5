"""DuckDB oracle SQL for every registered query that SQL can express.

Each string runs on the driver's raw tables; the shop views come from
``oracle_views.VIEWS_SQL``. Money is summed in whole cents and divided by
100.0 at the end; means are rounded half up in integers.
"""

from __future__ import annotations

from oracle_views import with_views

AS_OF = "DATE '2001-08-01'"
FULL = ("DATE '1995-01-01'", "DATE '2001-08-01'")
W30 = ("DATE '2001-07-02'", "DATE '2001-08-01'")       # as_of - 30 .. as_of
M6 = ("DATE '2001-02-02'", "DATE '2001-08-01'")        # first of month - 180 days .. as_of

SQL: dict[str, str] = {}


def q(name: str, body: str) -> None:
    SQL[name] = with_views(body)


def done(lo: str, hi: str, alias: str = "s") -> str:
    return f"{alias}.status = 'completed' AND {alias}.sale_day BETWEEN {lo} AND {hi}"


def per_sale(lo: str, hi: str) -> str:
    return f""",
per_sale AS (
  SELECT s.id, s.sale_day, s.gt_c, s.customer_name, coalesce(n.items, 0) AS items
  FROM sales s LEFT JOIN (SELECT sale_id, count(*) AS items FROM sale_items GROUP BY sale_id) n
    ON n.sale_id = s.id
  WHERE {done(lo, hi)}
)"""


def half_up_mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN ((2 * {total} + {n}) // (2 * {n})) / 100.0 ELSE 0.0 END"


def ratio(total_c: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN ({total_c} / 100.0) / {n} ELSE 0.0 END"


def period_report(key: str, lo: str, hi: str) -> str:
    return per_sale(lo, hi) + f"""
SELECT CAST({key} AS VARCHAR) AS period, CAST(count(*) AS BIGINT) AS sales_count,
  sum(gt_c) / 100.0 AS total_revenue,
  {half_up_mean('sum(gt_c)', 'count(*)')} AS avg_order_value,
  CAST(sum(items) AS BIGINT) AS total_items
FROM per_sale GROUP BY 1"""


def lines_of(lo: str | None, hi: str | None, extra: str = "") -> str:
    cond = "status = 'completed'"
    if lo:
        cond += f" AND sale_day >= {lo}"
    if hi:
        cond += f" AND sale_day <= {hi}"
    return f""",
lines AS (SELECT * FROM sale_items WHERE sale_id IN (SELECT id FROM sales WHERE {cond}) {extra})"""


# ---------------------------------------------------------------- sales family
q("sales_by_day", period_report("sale_day", *FULL))
q("sales_by_week", period_report("strftime(sale_day, '%Y-W%U')", *FULL))
q("sales_by_month", period_report("strftime(sale_day, '%Y-%m')", *FULL))
q("sales_all", period_report("'All'", *FULL))
q("chart_revenue", per_sale(*FULL) + """
SELECT CAST(sale_day AS VARCHAR) AS period, sum(gt_c) / 100.0 AS total_revenue FROM per_sale GROUP BY 1""")

q("sales_period_summary", per_sale(*FULL) + f"""
SELECT CAST(count(*) AS BIGINT) AS total_sales,
  coalesce(sum(gt_c) / 100.0, 0.0) AS total_revenue,
  {ratio('sum(gt_c)', 'count(*)')} AS avg_order_value,
  max(gt_c) / 100.0 AS max_order, min(gt_c) / 100.0 AS min_order,
  CAST(count(DISTINCT customer_name) AS BIGINT) AS total_customers,
  CAST(coalesce(sum(items), 0) AS BIGINT) AS total_products_sold,
  2405 AS days
FROM per_sale""")

q("payment_method_counts", f"""
SELECT payment_method, CAST(count(*) AS BIGINT) AS sales_count FROM sales s
WHERE {done(*FULL)} GROUP BY 1""")

q("sales_report_totals", per_sale(*FULL) + f"""
SELECT CAST(count(*) AS BIGINT) AS total_sales, coalesce(sum(gt_c) / 100.0, 0.0) AS total_revenue,
  CAST(coalesce(sum(items), 0) AS BIGINT) AS total_products_sold,
  {ratio('sum(gt_c)', 'count(*)')} AS average_order_value
FROM per_sale""")

BY_PRODUCT = """
SELECT product_name, product_sku, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  sum(tot_c) / 100.0 AS total_revenue, (sum(up_c) / 100.0) / count(*) AS avg_price
FROM lines GROUP BY 1, 2"""
q("sales_by_product", lines_of(*FULL) + BY_PRODUCT)

q("sales_by_product_summary", lines_of(*FULL) + """,
g AS (SELECT product_name, product_sku, sum(quantity) AS qn, sum(tot_c) AS rev FROM lines GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS total_products,
  CAST(coalesce(sum(qn), 0) AS BIGINT) AS total_quantity,
  coalesce(sum(rev) / 100.0, 0.0) AS total_revenue,
  (SELECT product_name FROM g ORDER BY rev DESC, product_name, product_sku LIMIT 1) AS top_product,
  max(rev) / 100.0 AS top_product_revenue
FROM g""")

BY_ID = """
SELECT product_id, product_name, product_sku, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  sum(tot_c) / 100.0 AS total_revenue, (sum(up_c) / 100.0) / count(*) AS avg_price, sum(tot_c) AS rev
FROM lines GROUP BY 1, 2, 3"""
q("sales_by_product_id", lines_of(None, None) + f""",
g AS ({BY_ID})
SELECT product_id, product_name, product_sku, total_quantity, total_revenue, avg_price FROM g""")

q("sales_by_product_id_totals", lines_of(None, None) + f""",
g AS ({BY_ID})
SELECT CAST(count(*) AS BIGINT) AS total_products, CAST(coalesce(sum(total_quantity), 0) AS BIGINT) AS total_quantity,
  coalesce(sum(rev) / 100.0, 0.0) AS total_revenue FROM g""")

q("top_by_quantity", lines_of(*W30) + f""",
g AS ({BY_ID})
SELECT product_id, product_name, product_sku, total_quantity, total_revenue, avg_price FROM g
ORDER BY total_quantity DESC, product_id, product_name, product_sku LIMIT 10""")

q("top_by_revenue", lines_of(*W30) + f""",
g AS ({BY_ID})
SELECT product_id, product_name, product_sku, total_quantity, total_revenue, avg_price FROM g
ORDER BY rev DESC, total_quantity DESC, product_id, product_name, product_sku LIMIT 10""")

q("top_products_report", lines_of(*W30) + """,
g AS (SELECT product_name, product_sku, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  sum(tot_c) AS rev, (sum(up_c) / 100.0) / count(*) AS avg_price FROM lines GROUP BY 1, 2)
SELECT product_name, product_sku, total_quantity, rev / 100.0 AS total_revenue, avg_price FROM g
ORDER BY rev DESC, product_name, product_sku LIMIT 10""")

q("daily_sales", f"""
SELECT CAST(sale_day AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS sales_count, sum(gt_c) / 100.0 AS total_revenue
FROM sales s WHERE {done(*W30)} GROUP BY 1""")

q("sales_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total_sales, coalesce(sum(gt_c) / 100.0, 0.0) AS total_revenue,
  {ratio('sum(gt_c)', 'count(*)')} AS avg_order_value,
  CAST(count(*) FILTER (WHERE sale_day = {AS_OF}) AS BIGINT) AS today_sales,
  coalesce(sum(CASE WHEN sale_day = {AS_OF} THEN gt_c END) / 100.0, 0.0) AS today_revenue
FROM sales WHERE status = 'completed'""")

q("most_sold_30d", """,
lines AS (SELECT * FROM sale_items WHERE sale_id IN
  (SELECT id FROM sales WHERE status = 'completed' AND sale_date >= TIMESTAMP '2001-07-02 00:00:00'))
SELECT product_name AS name, CAST(sum(quantity) AS BIGINT) AS quantity, sum(tot_c) / 100.0 AS revenue
FROM lines GROUP BY 1 ORDER BY quantity DESC, name LIMIT 10""")

q("sales_daily_report", period_report("sale_day", *W30))
q("sales_monthly_report", period_report("strftime(sale_day, '%Y-%m')", *M6))

q("quick_sales", f"""
SELECT CAST(count(*) AS BIGINT) AS total_sales, coalesce(sum(gt_c) / 100.0, 0.0) AS total_revenue,
  {ratio('sum(gt_c)', 'count(*)')} AS avg_order_value, 30 AS days
FROM sales s WHERE {done(*W30)}""")

q("quick_top5", lines_of(*W30) + """
SELECT product_name AS product, CAST(sum(quantity) AS BIGINT) AS quantity FROM lines
GROUP BY 1 ORDER BY quantity DESC, product LIMIT 5""")

q("trend_7d", """,
counts AS (SELECT sale_day, count(*) AS n FROM sales WHERE status = 'completed'
  AND sale_day BETWEEN DATE '2001-07-25' AND DATE '2001-07-31' GROUP BY 1),
cal AS (SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '2001-07-25', TIMESTAMP '2001-07-31',
  INTERVAL 1 DAY) t(d))
SELECT CAST(cal.date AS VARCHAR) AS date, CAST(coalesce(counts.n, 0) AS BIGINT) AS sales FROM cal LEFT JOIN counts ON counts.sale_day = cal.date""")

q("recent_sales", """
SELECT id, sale_number, customer_name, gt_c / 100.0 AS grand_total, status, sale_date FROM sales
ORDER BY sale_date DESC NULLS FIRST, id DESC LIMIT 5""")

q("recent_revenue", """,
latest AS (SELECT gt_c FROM sales ORDER BY sale_date DESC NULLS FIRST, id DESC LIMIT 5)
SELECT CAST(least((SELECT count(*) FROM products WHERE is_active), 100) AS BIGINT) AS products_listed,
  (SELECT CAST(count(*) AS BIGINT) FROM latest) AS sales_listed,
  (SELECT coalesce(sum(gt_c) / 100.0, 0.0) FROM latest) AS recent_revenue""")

# ---------------------------------------------------------------- inventory and product reports
PCOLS = """id, sku, name, description, CAST(category_id AS BIGINT) AS category_id, supplier_id,
  cost_c / 100.0 AS cost_price, sp_c / 100.0 AS selling_price,
  CASE WHEN cost_c > 0 THEN CAST(100 * (sp_c - cost_c) AS DOUBLE) / cost_c END AS margin,
  current_stock, min_stock_level, max_stock_level, brand, barcode, is_active"""
SCOLS = """id, sale_number, customer_name, gt_c / 100.0 AS grand_total, payment_method, payment_status,
  status, user_id, sale_date"""
STATUS = """CASE WHEN current_stock = 0 THEN 'Out of Stock' WHEN current_stock <= min_stock_level THEN 'Low Stock'
  WHEN current_stock <= 2 * min_stock_level THEN 'Adequate' ELSE 'Over Stock' END"""
TYPE_FILTER = {
    "stock_summary": "TRUE",
    "low_stock": "current_stock <= min_stock_level",
    "out_of_stock": "current_stock = 0",
    "slow_moving": "current_stock > 0",
}
NAMED = """products p LEFT JOIN categories c ON p.category_id = c.id LEFT JOIN suppliers s ON p.supplier_id = s.id"""
CAT_NA = "CASE WHEN c.id IS NULL THEN 'N/A' ELSE c.name END"
SUP_NA = "CASE WHEN s.id IS NULL THEN 'N/A' ELSE s.name END"

q("inventory_summary", """
SELECT CAST(count(*) AS BIGINT) AS total_products, CAST(coalesce(sum(current_stock), 0) AS BIGINT) AS total_stock,
  coalesce(sum(current_stock * cost_c) / 100.0, 0.0) AS total_inventory_value,
  coalesce(sum(current_stock * sp_c) / 100.0, 0.0) AS total_potential_revenue,
  CAST(count(*) FILTER (WHERE current_stock <= min_stock_level) AS BIGINT) AS low_stock_count,
  CAST(count(*) FILTER (WHERE current_stock = 0) AS BIGINT) AS out_of_stock_count
FROM products WHERE is_active""")

for _t, _f in TYPE_FILTER.items():
    _n = "inventory_report" if _t == "stock_summary" else f"inventory_report_{_t}"
    q(_n, f"""
SELECT p.id AS product_id, p.sku, p.name, {CAT_NA} AS category, {SUP_NA} AS supplier,
  current_stock, min_stock_level, max_stock_level, cost_c / 100.0 AS cost_price, sp_c / 100.0 AS selling_price,
  current_stock * cost_c / 100.0 AS stock_value, current_stock * sp_c / 100.0 AS selling_value,
  {STATUS} AS stock_status
FROM {NAMED} WHERE p.is_active AND {_f}""")


def _inv_summary(f: str) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS total_products, CAST(coalesce(sum(current_stock), 0) AS BIGINT) AS total_stock_units,
  coalesce(sum(current_stock * cost_c) / 100.0, 0.0) AS total_stock_value,
  coalesce(sum(current_stock * sp_c) / 100.0, 0.0) AS total_selling_value,
  avg(current_stock) AS avg_stock_level,
  CAST(count(*) FILTER (WHERE current_stock <= min_stock_level) AS BIGINT) AS low_stock_count,
  CAST(count(*) FILTER (WHERE current_stock = 0) AS BIGINT) AS out_of_stock_count,
  CAST(count(*) FILTER (WHERE current_stock > max_stock_level) AS BIGINT) AS over_stock_count
FROM products WHERE is_active AND {f}"""


q("inventory_report_summary", _inv_summary(TYPE_FILTER["stock_summary"]))
q("inventory_report_summary_low_stock", _inv_summary(TYPE_FILTER["low_stock"]))

q("stock_status_counts", f"""
SELECT {STATUS} AS stock_status, CAST(count(*) AS BIGINT) AS product_count FROM products WHERE is_active GROUP BY 1""")

q("quick_inventory", """
SELECT CAST(count(*) AS BIGINT) AS total_products, coalesce(sum(current_stock * cost_c) / 100.0, 0.0) AS total_stock_value,
  CAST(count(*) FILTER (WHERE current_stock <= min_stock_level) AS BIGINT) AS low_stock_count,
  CAST(count(*) FILTER (WHERE current_stock = 0) AS BIGINT) AS out_of_stock_count
FROM products WHERE is_active""")

q("category_distribution", """
SELECT c.name AS category, CAST(count(p.id) AS BIGINT) AS product_count
FROM categories c LEFT JOIN products p ON p.category_id = c.id GROUP BY c.name""")


def _product_report(where: str) -> str:
    return f"""
SELECT p.id AS product_id, p.sku, p.name, p.description, {CAT_NA} AS category, {SUP_NA} AS supplier,
  p.brand, p.model, p.current_stock, cost_c / 100.0 AS cost_price, sp_c / 100.0 AS selling_price,
  CASE WHEN cost_c > 0 THEN CAST(100 * (sp_c - cost_c) AS DOUBLE) / cost_c END AS margin_percent,
  current_stock * cost_c / 100.0 AS stock_value, p.is_active, CAST(NULL AS TIMESTAMP) AS last_restocked,
  p.created_at
FROM {NAMED} WHERE {where}"""


q("product_report", _product_report("p.is_active"))
q("product_report_filtered", _product_report("p.category_id = 3"))


def _product_summary(where: str) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS total_products,
  CAST(count(*) FILTER (WHERE p.is_active) AS BIGINT) AS active_products,
  coalesce(sum(current_stock * cost_c) / 100.0, 0.0) AS total_stock_value,
  {ratio('sum(cost_c)', 'count(*)')} AS avg_cost_price,
  {ratio('sum(sp_c)', 'count(*)')} AS avg_selling_price,
  CASE WHEN count(m) > 0 THEN CAST(sum(m) AS DOUBLE) / count(m) END AS avg_margin,
  CAST(count(DISTINCT {CAT_NA}) AS BIGINT) AS categories_count,
  CAST(count(DISTINCT {SUP_NA}) AS BIGINT) AS suppliers_count
FROM (SELECT *, CAST(CASE WHEN cost_c > 0 THEN CAST(100 * (sp_c - cost_c) AS DOUBLE) / cost_c END
      AS DECIMAL(24, 4)) AS m FROM products) p
  LEFT JOIN categories c ON p.category_id = c.id LEFT JOIN suppliers s ON p.supplier_id = s.id
WHERE {where}"""


q("product_report_summary", _product_summary("p.is_active"))
q("product_report_summary_all", _product_summary("TRUE"))

# ---------------------------------------------------------------- lookups, lists, search, joins
q("product_by_key", f"""
SELECT {PCOLS} FROM products WHERE sku IN (SELECT product_sku FROM sale_items
  WHERE sale_id IN (SELECT id FROM sales WHERE status = 'cancelled'))""")
q("sale_by_key", f"""
SELECT {SCOLS} FROM sales WHERE sale_number IN (SELECT sale_number FROM sales
  WHERE id IN (SELECT sale_id FROM sale_items WHERE quantity = 50))""")
q("category_by_key", """
SELECT CAST(id AS BIGINT) AS id, name, description FROM categories WHERE id IN (SELECT category_id FROM products)""")
q("supplier_by_key", """
SELECT id, name, email, country FROM suppliers WHERE id IN (SELECT supplier_id FROM products WHERE current_stock = 0)""")
q("product_list", f"SELECT {PCOLS} FROM products WHERE is_active")
q("product_list_filtered", f"SELECT {PCOLS} FROM products WHERE is_active AND category_id = 3")
q("product_list_page", f"SELECT {PCOLS} FROM products ORDER BY id LIMIT 1000 OFFSET 100")


def _ilike_any(cols: list[str], term: str) -> str:
    return " OR ".join(f"{c} ILIKE '%{term}%'" for c in cols)


q("product_search", f"SELECT {PCOLS} FROM products WHERE "
  + _ilike_any(["name", "sku", "barcode", "brand", "description"], "Ring"))
q("product_search_wildcard", f"SELECT {PCOLS} FROM products WHERE "
  + _ilike_any(["name", "sku", "barcode", "brand", "description"], "brand#1_"))
q("supplier_search", "SELECT id, name, email, phone FROM suppliers WHERE "
  + _ilike_any(["name", "contact_person", "email", "phone"], "00000001"))
q("supplier_list", """
SELECT id, name, contact_person, email, phone, country, is_active, rating FROM suppliers WHERE is_active""")
q("category_list", "SELECT CAST(id AS BIGINT) AS id, name, description FROM categories")
q("low_stock", f"SELECT {PCOLS} FROM products WHERE is_active AND current_stock <= min_stock_level")
q("out_of_stock", f"SELECT {PCOLS} FROM products WHERE is_active AND current_stock = 0")
q("slow_moving", f"SELECT {PCOLS} FROM products WHERE is_active AND current_stock > 0")
q("sale_list", f"""
SELECT {SCOLS.replace('id,', 's.id,', 1)}, coalesce(nullif(u.full_name, ''), u.username) AS user_name
FROM sales s LEFT JOIN users u ON s.user_id = u.id
WHERE status = 'completed' AND payment_status = 'paid'
  AND sale_date >= TIMESTAMP '1996-01-01 00:00:00' AND sale_date <= TIMESTAMP '1999-12-31 00:00:00'""")
q("sales_in_range", f"""
SELECT {SCOLS} FROM sales WHERE sale_day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
q("product_table", """
SELECT id, sku, name, current_stock, current_stock <= min_stock_level AS reorder,
  cost_c / 100.0 AS cost_price, sp_c / 100.0 AS selling_price,
  CASE WHEN coalesce(is_active, FALSE) THEN 'Active' ELSE 'Inactive' END AS status_label
FROM products""")
q("sale_table", """
SELECT s.id, s.sale_number, coalesce(s.sale_date, s.created_at) AS date,
  coalesce(nullif(s.customer_name, ''), 'Walk-in') AS customer,
  CAST(coalesce(n.items, 0) AS BIGINT) AS items_count, s.gt_c / 100.0 AS grand_total, s.status
FROM sales s LEFT JOIN (SELECT sale_id, count(*) AS items FROM sale_items GROUP BY sale_id) n ON n.sale_id = s.id""")
PCOLS_P = """p.id, p.sku, p.name, p.description, CAST(p.category_id AS BIGINT) AS category_id, p.supplier_id,
  p.cost_c / 100.0 AS cost_price, p.sp_c / 100.0 AS selling_price,
  CASE WHEN p.cost_c > 0 THEN CAST(100 * (p.sp_c - p.cost_c) AS DOUBLE) / p.cost_c END AS margin,
  p.current_stock, p.min_stock_level, p.max_stock_level, p.brand, p.barcode, p.is_active"""
q("product_enriched", f"""
SELECT {PCOLS_P}, c.name AS category_name, s.name AS supplier_name FROM {NAMED}""")
q("products_by_category", f"""
SELECT {PCOLS} FROM products WHERE is_active AND category_id IN (SELECT id FROM categories WHERE name ILIKE '%ar%')""")
q("products_by_supplier", f"""
SELECT {PCOLS} FROM products WHERE is_active AND supplier_id IN (SELECT id FROM suppliers WHERE name ILIKE '%00000001%')""")
q("product_with_details", f"""
SELECT p.id, p.sku, c.name AS category_name, s.name AS supplier_name, CAST(c.id AS BIGINT) AS category_struct_id,
  c.description AS category_description, s.email AS supplier_email, s.country AS supplier_country,
  s.rating AS supplier_rating, s.is_active AS supplier_is_active
FROM {NAMED} WHERE p.is_active""")
q("product_detail", f"""
SELECT p.id, p.name, c.name AS category_name, s.name AS supplier_name, s.contact_person AS supplier_contact,
  s.email AS supplier_email
FROM {NAMED}""")
q("sale_with_items", """
SELECT s.id, s.sale_number, coalesce(nullif(u.full_name, ''), u.username) AS user_name,
  CAST(coalesce(n.c, 0) AS BIGINT) AS item_count, CAST(coalesce(n.u, 0) AS BIGINT) AS units,
  coalesce(n.t, 0) / 100.0 AS items_total
FROM sales s LEFT JOIN users u ON s.user_id = u.id
  LEFT JOIN (SELECT sale_id, count(*) AS c, sum(quantity) AS u, sum(tot_c) AS t FROM sale_items GROUP BY sale_id) n
  ON n.sale_id = s.id""")
q("sale_lines", """,
ln AS (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY product_id, quantity, up_c, tax_rate, tax_c, discount_percent,
    disc_c, sub_c, tot_c, product_name, product_sku, product_barcode NULLS FIRST) AS line_no FROM sale_items)
SELECT s.id AS sale_id, s.sale_number, coalesce(nullif(u.full_name, ''), u.username) AS user_name,
  CAST(coalesce(n.c, 0) AS BIGINT) AS line_count, ln.line_no, ln.product_id, ln.quantity, ln.tot_c / 100.0 AS total
FROM sales s LEFT JOIN users u ON s.user_id = u.id LEFT JOIN ln ON ln.sale_id = s.id
  LEFT JOIN (SELECT sale_id, count(*) AS c FROM sale_items GROUP BY sale_id) n ON n.sale_id = s.id""")
q("fk_violations", """
SELECT 'sale_line_product' AS kind, sale_id AS request_id, product_id AS missing_key FROM sale_items
  WHERE product_id NOT IN (SELECT id FROM products)
UNION ALL
SELECT 'product_category', id, CAST(category_id AS BIGINT) FROM products
  WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM categories)
UNION ALL
SELECT 'product_supplier', id, supplier_id FROM products
  WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM suppliers)""")
q("category_performance", """,
lines AS (SELECT * FROM sale_items WHERE sale_id IN (SELECT id FROM sales WHERE status = 'completed'
  AND sale_day BETWEEN DATE '2001-05-03' AND DATE '2001-08-01'))
SELECT CASE WHEN c.id IS NULL THEN 'N/A' ELSE c.name END AS category, CAST(sum(l.quantity) AS BIGINT) AS total_quantity,
  sum(l.tot_c) / 100.0 AS total_revenue, (sum(l.up_c) / 100.0) / count(*) AS avg_price,
  CAST(count(*) AS BIGINT) AS line_count
FROM lines l LEFT JOIN products p ON l.product_id = p.id LEFT JOIN categories c ON p.category_id = c.id
GROUP BY 1""")

# ---------------------------------------------------------------- table changes (I family)
q("priced_lines", """
SELECT i.sale_id AS request_id, i.product_id, i.quantity, i.up_c / 100.0 AS unit_price, i.tax_rate,
  i.tax_c / 100.0 AS tax_amount, i.discount_percent, i.disc_c / 100.0 AS discount_amount,
  i.sub_c / 100.0 AS subtotal, i.tot_c / 100.0 AS total, p.name AS product_name, p.sku AS product_sku,
  p.barcode AS product_barcode
FROM sale_items i JOIN products p ON p.id = i.product_id""")

q("priced_sales", """,
a AS (SELECT sale_id, sum(sub_c) AS s, sum(up_c * q * (100 - d) * t) AS xt, sum(up_c * q * d) AS xd,
  count(*) AS n FROM sale_items GROUP BY sale_id)
SELECT s.id AS request_id, coalesce(a.s, 0) / 100.0 AS total_amount,
  ((coalesce(a.xt, 0) + 5000) // 10000) / 100.0 AS tax_amount,
  ((coalesce(a.xd, 0) + 50) // 100) / 100.0 AS discount_amount,
  ((10000 * coalesce(a.s, 0) + coalesce(a.xt, 0) - 100 * coalesce(a.xd, 0) + 5000) // 10000) / 100.0 AS grand_total,
  s.payment_method, s.status,
  CASE WHEN s.payment_method = 'cash' AND s.status = 'completed' THEN 'paid' ELSE s.payment_status END AS payment_status,
  CAST(coalesce(a.n, 0) AS BIGINT) AS line_count
FROM sales s LEFT JOIN a ON a.sale_id = s.id""")

q("sale_numbers", """,
ex AS (SELECT substring(sale_number, 5, 8) AS day_key,
  max(CAST(split_part(sale_number, '-', 3) AS BIGINT)) AS last_seq
  FROM sales WHERE status <> 'draft' AND sale_number LIKE 'SAL-%' GROUP BY 1),
nw AS (SELECT id, sale_date, strftime(sale_date, '%Y%m%d') AS day_key,
  row_number() OVER (PARTITION BY strftime(sale_date, '%Y%m%d') ORDER BY sale_date, id) AS rk
  FROM sales WHERE status = 'draft')
SELECT nw.id AS request_id, nw.sale_date, CAST(coalesce(ex.last_seq, 0) + rk AS BIGINT) AS seq,
  'SAL-' || nw.day_key || '-' || printf('%03d', coalesce(ex.last_seq, 0) + rk) AS sale_number
FROM nw LEFT JOIN ex ON ex.day_key = nw.day_key""")

q("stock_check", """
SELECT i.sale_id AS request_id, i.product_id, i.quantity,
  (p.id IS NOT NULL AND i.quantity <= p.current_stock) AS ok,
  CASE WHEN p.id IS NULL THEN printf('Product ID %d not found', i.product_id)
    WHEN NOT (i.quantity <= p.current_stock) THEN printf('Insufficient stock for %s. Available: %d', p.name, p.current_stock)
  END AS message
FROM sale_items i LEFT JOIN products p ON p.id = i.product_id
WHERE i.sale_id IN (SELECT id FROM sales WHERE status = 'draft')""")

q("cancel_sales", """
SELECT id AS request_id, status <> 'cancelled' AS accepted,
  CASE WHEN status = 'cancelled' THEN 'Sale is already cancelled' ELSE 'Sale cancelled successfully' END AS message
FROM sales WHERE payment_method = 'card'""")
q("cancel_sales_stock", """
SELECT p.id, CAST(p.current_stock + coalesce(b.q, 0) AS INTEGER) AS current_stock
FROM products p LEFT JOIN (SELECT product_id, sum(quantity) AS q FROM sale_items WHERE sale_id IN
  (SELECT id FROM sales WHERE payment_method = 'card' AND status <> 'cancelled') GROUP BY 1) b ON b.product_id = p.id""")
q("cancel_sales_status", """
SELECT id,
  CASE WHEN payment_method = 'card' AND status <> 'cancelled' THEN 'cancelled' ELSE status END AS status,
  CASE WHEN payment_method = 'card' AND status <> 'cancelled'
    THEN (CASE WHEN payment_status = 'paid' THEN 'refunded' ELSE 'pending' END) ELSE payment_status END AS payment_status
FROM sales""")

q("patch_sales", """
SELECT id AS request_id, status NOT IN ('completed', 'cancelled') AS accepted,
  CASE WHEN status IN ('completed', 'cancelled') THEN 'Cannot update ' || status || ' sale'
    ELSE 'Sale updated successfully' END AS message
FROM sales WHERE payment_method = 'upi'""")
q("patch_sales_rows", """
SELECT id,
  CASE WHEN payment_method = 'upi' AND status NOT IN ('completed', 'cancelled') THEN upper(customer_name)
    ELSE customer_name END AS customer_name,
  CASE WHEN payment_method = 'upi' AND status NOT IN ('completed', 'cancelled') THEN 'priority' END AS notes,
  status
FROM sales""")

q("delete_drafts", """
SELECT id AS request_id, status = 'draft' AS accepted,
  CASE WHEN status = 'draft' THEN 'Sale deleted successfully' ELSE 'Sale not found or not a draft' END AS message
FROM sales WHERE payment_method = 'cheque'""")
q("delete_drafts_remaining", """,
gone AS (SELECT id FROM sales WHERE payment_method = 'cheque' AND status = 'draft')
SELECT CAST((SELECT count(*) FROM sales WHERE id NOT IN (SELECT id FROM gone)) AS BIGINT) AS sales_left,
  CAST((SELECT count(*) FROM sale_items WHERE sale_id NOT IN (SELECT id FROM gone)) AS BIGINT) AS items_left""")

MARGIN = "CASE WHEN cost_c > 0 THEN CAST(100 * (sp_c - cost_c) AS DOUBLE) / cost_c END"
q("add_products", """
SELECT id AS request_id, barcode IS NULL AS accepted,
  CASE WHEN barcode IS NOT NULL THEN 'Product with this barcode already exists' ELSE 'ok' END AS message
FROM products""")
q("add_products_new", f"""
SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY id) AS id, sku || '-V2' AS sku,
  {MARGIN} AS margin, current_stock,
  CASE WHEN current_stock > 0 THEN TIMESTAMP '2001-08-01 12:00:00' END AS last_restocked
FROM products WHERE barcode IS NULL""")
q("patch_products", """
SELECT id, (sp_c + 100) / 100.0 AS selling_price,
  CASE WHEN cost_c > 0 THEN CAST(100 * (sp_c + 100 - cost_c) AS DOUBLE) / cost_c END AS margin,
  CASE WHEN brand = 'Brand#1' THEN NULL ELSE description END AS description
FROM products""")
q("adjust_stock", """
SELECT id AS request_id, current_stock - min_stock_level >= 0 AS accepted,
  CASE WHEN current_stock - min_stock_level >= 0 THEN 'ok' ELSE 'Product not found or insufficient stock' END AS message
FROM products""")
q("adjust_stock_rows", """
SELECT id, CASE WHEN current_stock >= min_stock_level THEN current_stock - min_stock_level ELSE current_stock END
  AS current_stock FROM products""")
# One recursion step per place in a product's sequence, all products at once.
SQL["stock_ledger"] = with_views(""",
ch AS (SELECT i.sale_id AS request_id, i.product_id, CAST(sum(CASE WHEN s.status = 'cancelled' THEN i.q ELSE -i.q END) AS BIGINT) AS quantity
  FROM sale_items i JOIN sales s ON s.id = i.sale_id GROUP BY 1, 2),
seq AS MATERIALIZED (SELECT c.*, CAST(p.current_stock AS BIGINT) AS stock,
    row_number() OVER (PARTITION BY c.product_id ORDER BY c.request_id) AS n FROM ch c JOIN products p ON p.id = c.product_id),
run AS (
  SELECT product_id, request_id, quantity, n, stock + quantity >= 0 AS accepted,
    CASE WHEN stock + quantity >= 0 THEN stock + quantity ELSE stock END AS balance FROM seq WHERE n = 1
  UNION ALL
  SELECT s.product_id, s.request_id, s.quantity, s.n, r.balance + s.quantity >= 0,
    CASE WHEN r.balance + s.quantity >= 0 THEN r.balance + s.quantity ELSE r.balance END
  FROM run r JOIN seq s ON s.product_id = r.product_id AND s.n = r.n + 1)
SELECT request_id, product_id, quantity, accepted, balance FROM run""", recursive=True)
q("bulk_stock", "SELECT id AS product_id, current_stock + (10 - 2 * current_stock) >= 0 AS success FROM products")
q("deactivate_products", "SELECT id, CASE WHEN current_stock = 0 THEN FALSE ELSE is_active END AS is_active FROM products")
q("merge_dimension", """
SELECT CAST(substring(brand, 7, 10) AS BIGINT) AS request_id, TRUE AS accepted, 'ok' AS message
FROM (SELECT DISTINCT brand FROM products)
UNION ALL SELECT 1000, FALSE, 'Category with this name already exists'
UNION ALL SELECT 3, TRUE, 'ok'""")
q("merge_dimension_rows", """
SELECT CAST(id AS BIGINT) AS id, name, description FROM categories WHERE id <> 3
UNION ALL
SELECT CAST(7 + row_number() OVER (ORDER BY CAST(substring(brand, 7, 10) AS BIGINT)) AS BIGINT), brand, 'Brand ' || brand
FROM (SELECT DISTINCT brand FROM products)""")

# ---------------------------------------------------------------- data-quality rules (J family)
# Shop columns the oracle views do not carry are NULL, as in the Spark views.
DQ_PRODUCTS = """(SELECT id, sku, name, cost_c / 100.0 AS cost_price, sp_c / 100.0 AS selling_price, current_stock,
  min_stock_level, max_stock_level, unit_of_measure, brand, model, weight, CAST(NULL AS VARCHAR) AS dimensions,
  barcode, tax_rate FROM products)"""
DQ_SALES = """(SELECT id, sale_number, customer_name, CAST(NULL AS VARCHAR) AS customer_email,
  CAST(NULL AS VARCHAR) AS customer_phone, CAST(NULL AS VARCHAR) AS payment_reference,
  CAST(NULL AS VARCHAR) AS shipping_city, CAST(NULL AS VARCHAR) AS shipping_state,
  CAST(NULL AS VARCHAR) AS shipping_country, CAST(NULL AS VARCHAR) AS shipping_pincode,
  payment_method, payment_status, status, gt_c FROM sales)"""
DQ_SUPPLIERS = """(SELECT id, name, contact_person, email, phone, CAST(NULL AS VARCHAR) AS city,
  CAST(NULL AS VARCHAR) AS state, country, CAST(NULL AS VARCHAR) AS postal_code, CAST(NULL AS VARCHAR) AS tax_id,
  CAST(NULL AS VARCHAR) AS website, payment_terms, rating FROM suppliers)"""
LINE_KEY = "CAST(id AS VARCHAR)"


def _rules_sql(table: str, source: str, rules, key: str = "CAST(id AS VARCHAR)") -> str:
    parts = [f"SELECT '{table}' AS table_name, {key} AS record_key, '{name}' AS rule FROM {source} t "
             f"WHERE NOT coalesce({pred}, TRUE)" for name, pred in rules]
    return "\nUNION ALL\n".join(parts)


from stockline.operators import quality as _dq  # noqa: E402  (fixed rule texts only)

q("dq_product_checks", _rules_sql("products", DQ_PRODUCTS, _dq.PRODUCT_CHECKS))
q("dq_product_fields", _rules_sql("products", DQ_PRODUCTS, _dq.PRODUCT_FIELDS))
q("dq_sales", _rules_sql("sales", DQ_SALES, _dq.SALE_CHECKS))
q("dq_suppliers", _rules_sql("suppliers", DQ_SUPPLIERS, _dq.SUPPLIER_CHECKS + [
    ("email_shape", "regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")]))
q("dq_sale_lines", _rules_sql("sale_items", "(SELECT id, sale_id, product_id, quantity, up_c / 100.0 AS unit_price, "
                                            "tax_rate, discount_percent FROM sale_items)",
                              _dq.SALE_LINE_CHECKS, LINE_KEY) + """
UNION ALL
SELECT 'sales', CAST(id AS VARCHAR), 'has_lines' FROM sales WHERE id NOT IN (SELECT sale_id FROM sale_items)""")
_uniq = []
for _t, _c in _dq.UNIQUE:
    _uniq.append(f"SELECT '{_t}' AS table_name, CAST({_c} AS VARCHAR) AS record_key, 'unique_{_c}' AS rule "
                 f"FROM {_t} WHERE {_c} IS NOT NULL GROUP BY {_c} HAVING count(*) > 1")
q("dq_unique", "\nUNION ALL\n".join(_uniq))
q("dq_foreign_keys", f"""
SELECT 'products' AS table_name, CAST(id AS VARCHAR) AS record_key, 'fk_category' AS rule FROM products
  WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM categories)
UNION ALL SELECT 'products', CAST(id AS VARCHAR), 'fk_supplier' FROM products
  WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM suppliers)
UNION ALL SELECT 'sale_items', {LINE_KEY}, 'fk_sale' FROM sale_items WHERE sale_id NOT IN (SELECT id FROM sales)
UNION ALL SELECT 'sale_items', {LINE_KEY}, 'fk_product' FROM sale_items WHERE product_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'sales', CAST(id AS VARCHAR), 'fk_user' FROM sales
  WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)""")
_nn = []
_nn_src = {"products": DQ_PRODUCTS, "sales": "(SELECT *, gt_c AS total_amount, 0 AS tax_amount, 0 AS discount_amount,"
           " gt_c AS grand_total FROM sales)", "sale_items": "(SELECT *, up_c AS unit_price, tax_c AS tax_amount, "
           "disc_c AS discount_amount, sub_c AS subtotal, tot_c AS total FROM sale_items)"}
for _t, _cols in _dq.NOT_NULL.items():
    _key = LINE_KEY if _t == "sale_items" else "CAST(id AS VARCHAR)"
    _nn.append(_rules_sql(_t, _nn_src[_t], [(f"not_null_{c}", f"{c} IS NOT NULL") for c in _cols], _key))
q("dq_not_null", "\nUNION ALL\n".join(_nn))

# ---------------------------------------------------------------- data-quality rules on dirtied tables
# stockline.sources.dirty lists the same damage for both engines; here it is applied to the views by DuckDB.
from stockline.sources.dirty import DAMAGE as _DAMAGE  # noqa: E402

_DIRTY_SOURCE = {
    "products": """(SELECT id, sku, name, category_id, supplier_id, cost_c / 100.0 AS cost_price, sp_c / 100.0 AS selling_price,
      current_stock, min_stock_level, max_stock_level, unit_of_measure, brand, model, weight, CAST(NULL AS VARCHAR) AS dimensions, barcode, tax_rate
      FROM products)""",
    "sales": """(SELECT id, sale_number, customer_name, CAST(NULL AS VARCHAR) AS customer_email, CAST(NULL AS VARCHAR) AS customer_phone,
      CAST(NULL AS VARCHAR) AS payment_reference, CAST(NULL AS VARCHAR) AS shipping_city, CAST(NULL AS VARCHAR) AS shipping_state,
      CAST(NULL AS VARCHAR) AS shipping_country, CAST(NULL AS VARCHAR) AS shipping_pincode, payment_method, payment_status, status, user_id,
      gt_c / 100.0 AS total_amount, 0.0 AS tax_amount, 0.0 AS discount_amount, gt_c / 100.0 AS grand_total FROM sales)""",
    "sale_items": """(SELECT id, sale_id, product_id, quantity, up_c / 100.0 AS unit_price, tax_rate, tax_c / 100.0 AS tax_amount, discount_percent,
      disc_c / 100.0 AS discount_amount, sub_c / 100.0 AS subtotal, tot_c / 100.0 AS total, product_name, product_sku FROM sale_items)""",
    "suppliers": """(SELECT id, name, contact_person, email, phone, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state, country,
      CAST(NULL AS VARCHAR) AS postal_code, CAST(NULL AS VARCHAR) AS tax_id, CAST(NULL AS VARCHAR) AS website, payment_terms, rating FROM suppliers)""",
    "categories": "(SELECT id, name FROM categories)",
    "users": "(SELECT id, email, username FROM users)",
}


def _dirty(table: str) -> str:
    columns: dict[str, list[str]] = {}
    for column, when, value in _DAMAGE[table]:
        columns.setdefault(column, []).append(f"WHEN {when} THEN {value}")
    changed = ", ".join(f"CASE {' '.join(cases)} ELSE {c} END AS {c}" for c, cases in columns.items())
    return f"(SELECT * REPLACE ({changed}) FROM {_DIRTY_SOURCE[table]})"


def _dirty_rules(table: str, rules: list[tuple[str, str]]) -> str:
    return _rules_sql(table, _dirty(table), rules, "CAST(id AS VARCHAR)")


_EMAIL = [("email_shape", "regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")]
q("dq_dirty_product_checks", _dirty_rules("products", _dq.PRODUCT_CHECKS))
q("dq_dirty_product_fields", _dirty_rules("products", _dq.PRODUCT_FIELDS))
q("dq_dirty_sales", _dirty_rules("sales", _dq.SALE_CHECKS))
q("dq_dirty_suppliers", _dirty_rules("suppliers", _dq.SUPPLIER_CHECKS + _EMAIL))
q("dq_dirty_sale_lines", _dirty_rules("sale_items", _dq.SALE_LINE_CHECKS) + f"""
UNION ALL SELECT 'sales', CAST(s.id AS VARCHAR), 'has_lines' FROM sales s LEFT JOIN (SELECT DISTINCT sale_id FROM {_dirty('sale_items')}) l
  ON l.sale_id = s.id WHERE l.sale_id IS NULL""")
q("dq_dirty_not_null", "\nUNION ALL\n".join(
    _dirty_rules(_t, [(f"not_null_{c}", f"{c} IS NOT NULL") for c in _cols]) for _t, _cols in _dq.NOT_NULL.items()))
q("dq_dirty_unique", "\nUNION ALL\n".join(
    f"SELECT '{_t}' AS table_name, CAST({_c} AS VARCHAR) AS record_key, 'unique_{_c}' AS rule FROM {_dirty(_t)} WHERE {_c} IS NOT NULL "
    f"GROUP BY {_c} HAVING count(*) > 1" for _t, _c in _dq.UNIQUE))
_FKS = [("products", "category_id", "categories", "fk_category"), ("products", "supplier_id", "suppliers", "fk_supplier"),
        ("sale_items", "sale_id", "sales", "fk_sale"), ("sale_items", "product_id", "products", "fk_product"), ("sales", "user_id", "users", "fk_user")]
q("dq_dirty_foreign_keys", "\nUNION ALL\n".join(
    f"SELECT '{_t}' AS table_name, CAST(c.id AS VARCHAR) AS record_key, '{_r}' AS rule FROM {_dirty(_t)} c LEFT JOIN {_p} p ON p.id = c.{_k} "
    f"WHERE c.{_k} IS NOT NULL AND p.id IS NULL" for _t, _k, _p, _r in _FKS))
q("fk_violations_dirty", "\nUNION ALL\n".join(
    f"SELECT '{_kind}' AS kind, c.{_id} AS request_id, CAST(c.{_k} AS BIGINT) AS missing_key FROM {_dirty(_t)} c LEFT JOIN {_p} p ON p.id = c.{_k} "
    f"WHERE p.id IS NULL" + (f" AND c.{_k} IS NOT NULL" if _t == "products" else "")      # a line must name its product
    for _kind, _t, _id, _k, _p in [
        ("sale_line_product", "sale_items", "sale_id", "product_id", "products"), ("product_category", "products", "id", "category_id", "categories"),
        ("product_supplier", "products", "id", "supplier_id", "suppliers")]))

# ---------------------------------------------------------------- sinks (read back)
SQL["export_csv"] = SQL["sales_by_day"]
SQL["sink_json"] = SQL["sales_by_product"]
SQL["export_pair"] = SQL["inventory_report_summary"]
SQL["export_report"] = SQL["sales_daily_report"]


def _both_parts(data: str, summary: str) -> str:
    return (f"SELECT 'data' AS part, * FROM ({data})\nUNION ALL BY NAME SELECT 'summary' AS part, * FROM ({summary})")


SQL["export_pair_parts"] = _both_parts(SQL["inventory_report"], SQL["inventory_report_summary"])
SQL["export_report_parts"] = _both_parts(
    SQL["sales_daily_report"], SQL["sales_period_summary"].replace(FULL[0], W30[0]).replace("2405 AS days", "31 AS days"))
SQL["payment_method_map"] = SQL["payment_method_counts"]

# ---------------------------------------------------------------- I4 posting: the sequential rule replayed
# One recursion step per draft sale in arrival order; ``used`` maps a product
# to the units taken by the sales accepted so far.
POSTING = """,
reqs AS MATERIALIZED (SELECT id AS request_id, row_number() OVER (ORDER BY sale_date, id) AS rn
  FROM sales WHERE status = 'draft'),
col AS (SELECT sale_id AS request_id, product_id, CAST(sum(quantity) AS BIGINT) AS qty FROM sale_items
  WHERE sale_id IN (SELECT request_id FROM reqs) GROUP BY 1, 2),
ln AS MATERIALIZED (SELECT r.rn, c.request_id, c.product_id, c.qty,
    coalesce(CAST(p.current_stock AS BIGINT), -1) AS stock, p.name AS pname
  FROM col c JOIN reqs r ON r.request_id = c.request_id LEFT JOIN products p ON p.id = c.product_id),
per AS MATERIALIZED (SELECT r.rn, r.request_id,
    coalesce(list(ln.product_id ORDER BY ln.product_id) FILTER (WHERE ln.product_id IS NOT NULL), []) AS pids,
    coalesce(list(ln.qty ORDER BY ln.product_id) FILTER (WHERE ln.product_id IS NOT NULL), []) AS qtys,
    coalesce(list(ln.stock ORDER BY ln.product_id) FILTER (WHERE ln.product_id IS NOT NULL), []) AS stocks,
    coalesce(list(ln.pname ORDER BY ln.product_id) FILTER (WHERE ln.product_id IS NOT NULL), []) AS pnames
  FROM reqs r LEFT JOIN ln ON ln.rn = r.rn GROUP BY r.rn, r.request_id),
sim AS (
  SELECT 0::BIGINT AS rn, MAP([]::BIGINT[], []::BIGINT[]) AS used, NULL::BIGINT AS request_id,
    NULL::BOOLEAN AS ok, []::BIGINT[] AS before
  UNION ALL
  SELECT p.rn,
    CASE WHEN f.fits THEN map_concat(s.used, MAP(p.pids, list_transform(p.pids,
      lambda x, i: CAST(coalesce(s.used[x], 0) + p.qtys[i] AS BIGINT)))) ELSE s.used END,
    p.request_id, f.fits,
    list_transform(p.pids, lambda x: CAST(coalesce(s.used[x], 0) AS BIGINT))
  FROM sim s JOIN per p ON p.rn = s.rn + 1,
  LATERAL (SELECT coalesce(len(p.pids) > 0 AND list_bool_and(list_transform(p.pids,
      lambda x, i: p.stocks[i] >= 0 AND coalesce(s.used[x], 0) + p.qtys[i] <= p.stocks[i])), FALSE) AS fits) f
),
res AS MATERIALIZED (SELECT s.request_id, s.ok, s.before, p.pids, p.qtys, p.stocks, p.pnames,
    list_filter(generate_series(1, len(p.pids)), lambda i: s.before[i] + p.qtys[i] > p.stocks[i])[1] AS k
  FROM sim s JOIN per p ON p.rn = s.rn WHERE s.rn > 0)"""
SQL["post_sales"] = with_views(POSTING + """
SELECT request_id, ok AS accepted,
  CASE WHEN ok THEN 'Sale created successfully'
    WHEN len(pids) = 0 THEN 'At least one item required'
    WHEN list_bool_or(list_transform(stocks, lambda x: x < 0))
      THEN printf('Product ID %d not found', list_min(list_filter(pids, lambda x, i: stocks[i] < 0)))
    ELSE printf('Insufficient stock for %s. Available: %d', pnames[k], stocks[k] - before[k]) END AS message
FROM res""", recursive=True)
SQL["post_sales_stock"] = with_views(POSTING + """,
taken AS (SELECT l.product_id, sum(l.qty) AS q FROM ln l JOIN res r ON r.request_id = l.request_id
  WHERE r.ok GROUP BY 1)
SELECT pr.id, CAST(pr.current_stock - coalesce(t.q, 0) AS INTEGER) AS current_stock
FROM products pr LEFT JOIN taken t ON t.product_id = pr.id""", recursive=True)

# The accepted drafts as rows: ids and numbers follow the sales that exist, in arrival order.
POSTED = POSTING + """,
old AS (SELECT max(id) AS top FROM sales WHERE status <> 'draft'),
ex AS (SELECT substring(sale_number, 5, 8) AS day_key, max(CAST(split_part(sale_number, '-', 3) AS BIGINT)) AS last_seq
  FROM sales WHERE status <> 'draft' GROUP BY 1),
acc AS (SELECT s.*, old.top + row_number() OVER (ORDER BY s.sale_date, s.id) AS new_id, strftime(s.sale_date, '%Y%m%d') AS day_key,
    row_number() OVER (PARTITION BY strftime(s.sale_date, '%Y%m%d') ORDER BY s.sale_date, s.id) AS rk
  FROM sales s JOIN res r ON r.request_id = s.id CROSS JOIN old WHERE r.ok)"""
SQL["post_sales_rows"] = with_views(POSTED + """,
a AS (SELECT sale_id, sum(sub_c) AS s, sum(up_c * q * (100 - d) * t) AS xt, sum(up_c * q * d) AS xd FROM sale_items GROUP BY sale_id)
SELECT acc.new_id AS id, 'SAL-' || acc.day_key || '-' || printf('%03d', coalesce(ex.last_seq, 0) + rk) AS sale_number,
  acc.customer_name, a.s / 100.0 AS total_amount, ((a.xt + 5000) // 10000) / 100.0 AS tax_amount,
  ((a.xd + 50) // 100) / 100.0 AS discount_amount, ((10000 * a.s + a.xt - 100 * a.xd + 5000) // 10000) / 100.0 AS grand_total,
  acc.payment_method, CASE WHEN acc.payment_method = 'cash' THEN 'paid' ELSE acc.payment_status END AS payment_status,
  'completed' AS status, acc.user_id, acc.sale_date, TIMESTAMP '2001-08-01 12:00:00' AS created_at
FROM acc JOIN a ON a.sale_id = acc.id LEFT JOIN ex ON ex.day_key = acc.day_key""", recursive=True)
SQL["post_sales_items"] = with_views(POSTED + """
SELECT acc.new_id * 1000000000 + row_number() OVER (PARTITION BY acc.new_id ORDER BY i.product_id, i.quantity, i.up_c, i.tax_rate,
    i.discount_percent) AS id, acc.new_id AS sale_id, i.product_id, i.quantity, i.up_c / 100.0 AS unit_price, i.tax_rate, i.tax_c / 100.0 AS tax_amount,
  i.discount_percent, i.disc_c / 100.0 AS discount_amount, i.sub_c / 100.0 AS subtotal, i.tot_c / 100.0 AS total,
  p.name AS product_name, p.sku AS product_sku, p.barcode AS product_barcode, TIMESTAMP '2001-08-01 12:00:00' AS created_at
FROM acc JOIN sale_items i ON i.sale_id = acc.id JOIN products p ON p.id = i.product_id""", recursive=True)
