"""DuckDB twin of ``stockline.sources.views`` for the correctness oracle.

Same rules, written in SQL over the driver's tables. Money is carried as whole
cents (``*_c`` columns) because DuckDB divides decimals as doubles; the
oracle rounds in integers (half up) and divides by 100.0 only at the end.
"""

VIEWS_SQL = r"""
WITH
sales AS (
  SELECT
    o.o_orderkey AS id,
    'SAL-' || strftime(o.o_orderdate, '%Y%m%d') || '-' || printf('%03d', o.o_orderkey) AS sale_number,
    CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE c.c_name END AS customer_name,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS gt_c,
    CASE o.o_orderpriority WHEN '5-LOW' THEN 'cash' WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'upi'
      WHEN '3-MEDIUM' THEN 'bank_transfer' WHEN '4-NOT SPECIFIED' THEN 'cheque' END AS payment_method,
    CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '5-LOW' THEN 'paid'
      WHEN o.o_orderkey % 3 = 0 THEN 'pending' WHEN o.o_orderkey % 3 = 1 THEN 'paid' ELSE 'partial' END AS payment_status,
    CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'draft' WHEN 'P' THEN 'cancelled' END AS status,
    CASE WHEN o.o_orderkey % 10 = 9 THEN NULL ELSE o.o_orderkey % 10 END AS user_id,
    o.o_orderdate AS sale_date,
    o.o_orderdate AS created_at,
    CAST(o.o_orderdate AS DATE) AS sale_day
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
item_base AS (
  SELECT l.l_orderkey * 1000000000 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_extendedprice,
      l.l_quantity, l.l_discount, l.l_tax, l.l_shipdate) AS id, l.l_orderkey AS sale_id, l.l_partkey AS product_id, p.p_name AS product_name,
    CAST(l.l_quantity AS BIGINT) AS q,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS ep,
    CAST(round(l.l_tax * 100) AS BIGINT) AS t,
    CAST(round(l.l_discount * 100) AS BIGINT) AS d,
    l.l_shipdate AS created_at
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
item_cents AS (
  SELECT *, CASE WHEN q > 0 THEN (2 * ep + q) // (2 * q) ELSE 0 END AS upc FROM item_base
),
sale_items AS (
  SELECT id, sale_id, product_id, CAST(q AS INTEGER) AS quantity, upc AS up_c, q, t, d,
    CAST(t AS DOUBLE) AS tax_rate, CAST(d AS DOUBLE) AS discount_percent,
    upc * q AS sub_c,
    (upc * q * d + 50) // 100 AS disc_c,
    (upc * q * (100 - d) * t + 5000) // 10000 AS tax_c,
    (upc * q * (100 - d) * (100 + t) + 5000) // 10000 AS tot_c,
    product_name,
    'SKU-' || CAST(product_id AS VARCHAR) AS product_sku,
    CASE WHEN product_id % 11 = 0 THEN NULL ELSE '890' || printf('%010d', product_id) END AS product_barcode,
    created_at
  FROM item_cents
),
product_base AS (
  SELECT p.*, CAST(round(p.p_retailprice * 100) AS BIGINT) AS sp_c FROM part p
),
products AS (
  SELECT
    p_partkey AS id,
    'SKU-' || CAST(p_partkey AS VARCHAR) AS sku,
    p_name AS name,
    p_type || ' ' || p_name AS description,
    CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE
      CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
        WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END END AS category_id,
    CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE p_partkey % (SELECT count(*) FROM supplier) END AS supplier_id,
    CASE WHEN p_partkey % 40 = 0 THEN 0 ELSE (6 * sp_c + 5) // 10 END AS cost_c,
    sp_c,
    CAST((p_partkey * 7) % 121 AS INTEGER) AS current_stock,
    CAST(p_size AS INTEGER) AS min_stock_level,
    CAST(p_size + 50 AS INTEGER) AS max_stock_level,
    'pcs' AS unit_of_measure,
    p_brand AS brand,
    CAST(NULL AS VARCHAR) AS model,
    CAST(p_size AS DOUBLE) * 0.5 AS weight,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE '890' || printf('%010d', p_partkey) END AS barcode,
    p_partkey % 20 <> 0 AS is_active,
    TRUE AS is_taxable,
    18.0 AS tax_rate,
    TIMESTAMP '1995-01-01 00:00:00' AS created_at
  FROM product_base
),
categories AS (
  SELECT id, name, description, TIMESTAMP '1995-01-01 00:00:00' AS created_at FROM (
    SELECT CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
        WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS id,
      p_type AS name, 'Parts of type ' || p_type AS description
    FROM (SELECT DISTINCT p_type FROM part)
    UNION ALL SELECT 7, 'UNUSED', 'Category without products'
  ) WHERE id IS NOT NULL
),
suppliers AS (
  SELECT s.s_suppkey AS id, s.s_name AS name,
    'Contact ' || CAST(s.s_suppkey AS VARCHAR) AS contact_person,
    CASE WHEN s.s_suppkey % 9 = 0 THEN NULL ELSE 'supplier' || CAST(s.s_suppkey AS VARCHAR) || '@example.com' END AS email,
    '+91-' || CAST(s.s_suppkey + 9000000000 AS VARCHAR) AS phone,
    n.n_name AS country,
    s.s_suppkey % 7 <> 0 AS is_active,
    'Net 30' AS payment_terms,
    CAST(1 + s.s_suppkey % 5 AS INTEGER) AS rating,
    TIMESTAMP '1995-01-01 00:00:00' AS created_at
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
),
users AS (
  SELECT id, 'user' || CAST(id AS VARCHAR) || '@shop.example' AS email,
    'user' || CAST(id AS VARCHAR) AS username,
    CASE WHEN id % 2 = 0 THEN NULL WHEN id = 5 THEN '' ELSE 'User ' || CAST(id AS VARCHAR) END AS full_name,
    TRUE AS is_active, id = 1 AS is_admin
  FROM (SELECT DISTINCT o_orderkey % 10 AS id FROM orders) WHERE id <> 9
)
"""


def with_views(body: str, recursive: bool = False) -> str:
    """``body`` is either a SELECT or further CTEs starting with a comma."""
    head = VIEWS_SQL.replace("WITH\n", "WITH RECURSIVE\n", 1) if recursive else VIEWS_SQL
    body = body.strip()
    if body.startswith(","):
        return head + body
    return head + "\n" + body
