"""The six shop tables derived from the driver's TPC-H style tables.

Every rule is a plain expression, repeatable in any SQL engine (the DuckDB
twin is ``oracle_views.VIEWS_SQL``). Lookups (customer name, part name,
nation name) are left joins against a side grouped by its key: the grouping
tells Catalyst the key is unique, so a query that never uses the looked-up
column has the join removed by the optimizer instead of paying for it.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockline import schema as S
from stockline.functions.exprs import margin_percent
from stockline.sources.tables import Shop, read_source

# Fixed values of the view layer.
# The as-of date of the test data (last order date).
AS_OF = _dt.date(2001, 8, 1)
# Category ids of the part types, and the one category without products.
CATEGORY_IDS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
UNUSED_CATEGORY = (7, "UNUSED")
# Order priority -> payment method.
PRIORITY_METHOD = {"5-LOW": "cash", "1-URGENT": "card", "2-HIGH": "upi",
                   "3-MEDIUM": "bank_transfer", "4-NOT SPECIFIED": "cheque"}
# Order status -> sale status.
ORDER_STATUS = {"F": "completed", "O": "draft", "P": "cancelled"}
EPOCH = "1995-01-01 00:00:00"

def _cents_to_money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(S.MONEY)


def _map_values(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def _null_str() -> Column:
    return F.lit(None).cast("string")


def _lookup(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key (see module note on join removal)."""
    return df.groupBy(key).agg(*[F.any_value(c).alias(c) for c in cols])


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_source(spark, sf_dir, "orders")
    customer = _lookup(read_source(spark, sf_dir, "customer", ["c_custkey", "c_name"]),
                       "c_custkey", ["c_name"])
    o = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    key = F.col("o_orderkey")
    status = _map_values(F.col("o_orderstatus"), ORDER_STATUS)
    method = _map_values(F.col("o_orderpriority"), PRIORITY_METHOD)
    grand = _cents_to_money(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    zero = F.lit(Decimal("0.00")).cast(S.MONEY)
    pay = (F.when((status == "completed") & (method == "cash"), F.lit("paid"))
           .when(key % 3 == 0, F.lit("pending"))
           .when(key % 3 == 1, F.lit("paid"))
           .otherwise(F.lit("partial")))
    return o.select(
        key.alias("id"),
        F.format_string("SAL-%s-%03d", F.date_format("o_orderdate", "yyyyMMdd"), key).alias("sale_number"),
        F.when(key % 17 == 0, _null_str()).otherwise(F.col("c_name")).alias("customer_name"),
        _null_str().alias("customer_email"),
        _null_str().alias("customer_phone"),
        grand.alias("total_amount"),
        zero.alias("tax_amount"),
        zero.alias("discount_amount"),
        grand.alias("grand_total"),
        method.alias("payment_method"),
        pay.alias("payment_status"),
        _null_str().alias("payment_reference"),
        status.alias("status"),
        *[_null_str().alias(c) for c in ("shipping_address", "shipping_city", "shipping_state",
                                         "shipping_country", "shipping_pincode", "notes")],
        F.when(key % 10 == 9, F.lit(None).cast("bigint")).otherwise(key % 10).alias("user_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("sale_date"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def _barcode(partkey: Column) -> Column:
    return F.when(partkey % 11 == 0, _null_str()).otherwise(
        F.concat(F.lit("890"), F.format_string("%010d", partkey)))


def sale_items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_source(spark, sf_dir, "lineitem",
                     ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                      "l_tax", "l_shipdate"])
    # Line numbers repeat within an order, so a line's id is its place among its order's lines. A plan that does not
    # read the id has no window.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"))
    li = li.withColumn("_id", F.col("l_orderkey") * S.LINES_PER_SALE + place)
    part = _lookup(read_source(spark, sf_dir, "part", ["p_partkey", "p_name"]), "p_partkey", ["p_name"])
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    # Whole numbers first: q units, ep extended price in cents, t / d whole percents,
    # upc unit price in cents rounded half up = (2 ep + q) div (2 q).
    base = j.selectExpr(
        "_id AS id", "l_orderkey AS sale_id", "l_partkey AS product_id", "p_name AS product_name",
        "CAST(l_quantity AS BIGINT) AS q",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS ep",
        "CAST(round(l_tax * 100) AS BIGINT) AS t",
        "CAST(round(l_discount * 100) AS BIGINT) AS d",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) AS created_at")
    base = base.withColumn("upc", F.expr("CASE WHEN q > 0 THEN (2 * ep + q) div (2 * q) ELSE 0 END"))
    gross = "(upc * q)"
    return base.select(
        "id", "sale_id", "product_id",
        F.col("q").cast("int").alias("quantity"),
        _cents_to_money(F.col("upc")).alias("unit_price"),
        F.col("t").cast("double").alias("tax_rate"),
        _cents_to_money(F.expr(f"({gross} * (100 - d) * t + 5000) div 10000")).alias("tax_amount"),
        F.col("d").cast("double").alias("discount_percent"),
        _cents_to_money(F.expr(f"({gross} * d + 50) div 100")).alias("discount_amount"),
        _cents_to_money(F.expr(gross)).alias("subtotal"),
        _cents_to_money(F.expr(f"({gross} * (100 - d) * (100 + t) + 5000) div 10000")).alias("total"),
        "product_name",
        F.concat(F.lit("SKU-"), F.col("product_id").cast("string")).alias("product_sku"),
        _barcode(F.col("product_id")).alias("product_barcode"),
        "created_at",
    )


def products_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_source(spark, sf_dir, "part")
    n_suppliers = read_source(spark, sf_dir, "supplier", ["s_suppkey"]).agg(F.count("*")).scalar()
    key = F.col("p_partkey")
    sp = F.round(F.col("p_retailprice") * 100).cast("bigint")
    cost = F.when(key % 40 == 0, F.lit(0).cast("bigint")).otherwise(
        F.expr("(6 * CAST(round(p_retailprice * 100) AS BIGINT) + 5) div 10"))
    selling_price = _cents_to_money(sp)
    cost_price = _cents_to_money(cost)
    return part.select(
        key.alias("id"),
        F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", F.col("p_type"), F.col("p_name")).alias("description"),
        F.when(key % 50 == 0, F.lit(None).cast("bigint"))
         .otherwise(_map_values(F.col("p_type"), CATEGORY_IDS).cast("bigint")).alias("category_id"),
        F.when(key % 33 == 0, F.lit(None).cast("bigint"))
         .otherwise(key % n_suppliers).alias("supplier_id"),
        cost_price.alias("cost_price"),
        selling_price.alias("selling_price"),
        margin_percent(selling_price, cost_price).alias("margin"),
        ((key * 7) % 121).cast("int").alias("current_stock"),
        F.col("p_size").cast("int").alias("min_stock_level"),
        (F.col("p_size") + 50).cast("int").alias("max_stock_level"),
        F.lit("pcs").alias("unit_of_measure"),
        F.col("p_brand").alias("brand"),
        _null_str().alias("model"),
        (F.col("p_size").cast("double") * 0.5).alias("weight"),
        _null_str().alias("dimensions"),
        _barcode(key).alias("barcode"),
        (key % 20 != 0).alias("is_active"),
        F.lit(True).alias("is_taxable"),
        F.lit(18.0).alias("tax_rate"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_restocked"),
    )


def categories_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read_source(spark, sf_dir, "part", ["p_type"]).distinct()
    derived = types.select(
        _map_values(F.col("p_type"), CATEGORY_IDS).cast("bigint").alias("id"),
        F.col("p_type").alias("name"),
        F.concat(F.lit("Parts of type "), F.col("p_type")).alias("description"),
    ).where(F.col("id").isNotNull())
    unused = spark.range(1).select(
        F.lit(UNUSED_CATEGORY[0]).cast("bigint").alias("id"),
        F.lit(UNUSED_CATEGORY[1]).alias("name"),
        F.lit("Category without products").alias("description"))
    both = derived.unionByName(unused)
    return both.select("id", "name", "description",
                       F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
                       F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def suppliers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_source(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nation = _lookup(read_source(spark, sf_dir, "nation", ["n_nationkey", "n_name"]),
                     "n_nationkey", ["n_name"])
    j = sup.join(nation, sup.s_nationkey == nation.n_nationkey, "left")
    key = F.col("s_suppkey")
    return j.select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Contact "), key.cast("string")).alias("contact_person"),
        F.when(key % 9 == 0, _null_str()).otherwise(
            F.concat(F.lit("supplier"), key.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("+91-"), (key + F.lit(9000000000)).cast("string")).alias("phone"),
        _null_str().alias("address"), _null_str().alias("city"), _null_str().alias("state"),
        F.col("n_name").alias("country"),
        _null_str().alias("postal_code"), _null_str().alias("tax_id"), _null_str().alias("website"),
        (key % 7 != 0).alias("is_active"),
        F.lit("Net 30").alias("payment_terms"),
        (F.lit(1) + key % 5).cast("int").alias("rating"),
        _null_str().alias("notes"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = (read_source(spark, sf_dir, "orders", ["o_orderkey"])
           .select((F.col("o_orderkey") % 10).alias("id")).where(F.col("id") != 9).distinct())
    uid = F.col("id")
    return ids.select(
        uid.alias("id"),
        F.concat(F.lit("user"), uid.cast("string"), F.lit("@shop.example")).alias("email"),
        F.concat(F.lit("user"), uid.cast("string")).alias("username"),
        F.when(uid % 2 == 0, _null_str()).when(uid == 5, F.lit(""))
         .otherwise(F.concat(F.lit("User "), uid.cast("string"))).alias("full_name"),
        F.lit(True).alias("is_active"),
        (uid == 1).alias("is_admin"),
    )


def driver_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """The shop seen through the driver's tables at ``sf_dir``."""
    sf_dir = sf_dir.rstrip("/")
    return Shop({
        "sales": lambda: sales_view(spark, sf_dir),
        "sale_items": lambda: sale_items_view(spark, sf_dir),
        "products": lambda: products_view(spark, sf_dir),
        "categories": lambda: categories_view(spark, sf_dir),
        "suppliers": lambda: suppliers_view(spark, sf_dir),
        "users": lambda: users_view(spark, sf_dir),
    })
