"""Registered lookup, list, search and join queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from stockline.operators import filters as fl
from stockline.operators import joins as jn
from stockline.plans.registry import AS_OF, register, shop

# Columns of product and sale rows compared by the correctness gate.
PRODUCT_COLS = ["id", "sku", "name", "description", "category_id", "supplier_id", "cost_price",
                "selling_price", "margin", "current_stock", "min_stock_level", "max_stock_level",
                "brand", "barcode", "is_active"]
SALE_COLS = ["id", "sale_number", "customer_name", "grand_total", "payment_method", "payment_status",
             "status", "user_id", "sale_date"]


def _p(df):
    return df.select(*PRODUCT_COLS)


def _sl(df):
    return df.select(*SALE_COLS)


@register("product_by_key")
def product_by_key(spark, sf):
    """Products sold in cancelled sales, looked up by sku."""
    sh = shop(spark, sf)
    cancelled = sh.sales.where(F.col("status") == "cancelled").select(F.col("id").alias("sale_id"))
    keys = sh.sale_items.join(cancelled, "sale_id", "left_semi").select(F.col("product_sku").alias("sku"))
    return _p(fl.product_by_key(sh.products, keys, "sku"))


@register("sale_by_key")
def sale_by_key(spark, sf):
    """Sales that hold a bulk line (50 units), looked up by sale number."""
    sh = shop(spark, sf)
    bulk = sh.sale_items.where(F.col("quantity") == 50).select(F.col("sale_id").alias("id"))
    keys = sh.sales.join(bulk, "id", "left_semi").select("sale_number")
    return _sl(fl.sale_by_key(sh.sales, keys, "sale_number"))


@register("category_by_key")
def category_by_key(spark, sf):
    """Categories used by some product."""
    sh = shop(spark, sf)
    keys = sh.products.select(F.col("category_id").alias("id"))
    return fl.category_by_key(sh.categories, keys, "id").select("id", "name", "description")


@register("supplier_by_key")
def supplier_by_key(spark, sf):
    """Suppliers of out-of-stock products."""
    sh = shop(spark, sf)
    keys = sh.products.where(F.col("current_stock") == 0).select(F.col("supplier_id").alias("id"))
    return fl.supplier_by_key(sh.suppliers, keys, "id").select("id", "name", "email", "country")


@register("product_list")
def product_list(spark, sf):
    return _p(fl.product_list(shop(spark, sf).products))


@register("product_list_filtered")
def product_list_filtered(spark, sf):
    return _p(fl.product_list(shop(spark, sf).products, category_id=3, supplier_id=None, active_only=True))


@register("product_list_page")
def product_list_page(spark, sf):
    """second page of 1000 by id (skip 100)."""
    return _p(fl.product_list(shop(spark, sf).products, active_only=False, skip=100, limit=1000))


@register("product_search")
def product_search(spark, sf):
    return _p(fl.product_search(shop(spark, sf).products, "Ring"))


@register("product_search_wildcard")
def product_search_wildcard(spark, sf):
    """``_`` is a one-character wildcard: matches Brand#10 .. Brand#19."""
    return _p(fl.product_search(shop(spark, sf).products, "brand#1_"))


@register("supplier_search")
def supplier_search(spark, sf):
    return fl.supplier_search(shop(spark, sf).suppliers, "00000001").select("id", "name", "email", "phone")


@register("supplier_list")
def supplier_list(spark, sf):
    return fl.supplier_list(shop(spark, sf).suppliers, active_only=True).select(
        "id", "name", "contact_person", "email", "phone", "country", "is_active", "rating")


@register("category_list")
def category_list(spark, sf):
    return fl.category_list(shop(spark, sf).categories).select("id", "name", "description")


@register("low_stock")
def low_stock(spark, sf):
    return _p(fl.low_stock(shop(spark, sf).products))


@register("out_of_stock")
def out_of_stock(spark, sf):
    return _p(fl.out_of_stock(shop(spark, sf).products))


@register("slow_moving")
def slow_moving(spark, sf):
    return _p(fl.slow_moving(shop(spark, sf).products))


@register("sale_list")
def sale_list(spark, sf):
    sh = shop(spark, sf)
    out = fl.sale_list(sh.sales, sh.users, status="completed", payment_status="paid",
                       start=_dt.date(1996, 1, 1), end=_dt.date(1999, 12, 31))
    return out.select(*SALE_COLS, "user_name")


@register("sales_in_range")
def sales_in_range(spark, sf):
    return _sl(fl.sales_in_range(shop(spark, sf).sales, _dt.date(1998, 1, 1), _dt.date(1998, 12, 31)))


@register("product_table")
def product_table(spark, sf):
    return fl.product_table(shop(spark, sf).products)


@register("sale_table")
def sale_table(spark, sf):
    sh = shop(spark, sf)
    return fl.sale_table(sh.sales, sh.sale_items)


@register("product_enriched")
def product_enriched(spark, sf):
    sh = shop(spark, sf)
    return jn.product_enriched(sh.products, sh.categories, sh.suppliers).select(
        *PRODUCT_COLS, "category_name", "supplier_name")


@register("products_by_category")
def products_by_category(spark, sf):
    sh = shop(spark, sf)
    return _p(jn.products_by_category(sh.products, sh.categories, "ar"))


@register("products_by_supplier")
def products_by_supplier(spark, sf):
    sh = shop(spark, sf)
    return _p(jn.products_by_supplier(sh.products, sh.suppliers, "00000001"))


@register("product_with_details")
def product_with_details(spark, sf):
    """C6, nested structs flattened for the comparison."""
    sh = shop(spark, sf)
    n = jn.product_with_details(sh.products, sh.categories, sh.suppliers)
    return n.select("id", "sku", "category_name", "supplier_name",
                    F.col("category.id").alias("category_struct_id"),
                    F.col("category.description").alias("category_description"),
                    F.col("supplier.email").alias("supplier_email"),
                    F.col("supplier.country").alias("supplier_country"),
                    F.col("supplier.rating").alias("supplier_rating"),
                    F.col("supplier.is_active").alias("supplier_is_active"))


@register("product_detail")
def product_detail(spark, sf):
    sh = shop(spark, sf)
    n = jn.product_detail(sh.products, sh.categories, sh.suppliers)
    return n.select("id", "name", F.col("category.name").alias("category_name"),
                    F.col("supplier.name").alias("supplier_name"),
                    F.col("supplier.contact_person").alias("supplier_contact"),
                    F.col("supplier.email").alias("supplier_email"))


@register("sale_with_items")
def sale_with_items(spark, sf):
    """Per sale, number of lines, units and total read back from the
    nested items arrays."""
    sh = shop(spark, sf)
    n = jn.sale_item_arrays(sh.sales, sh.sale_items, sh.users)
    per_row = n.select(
        "id", "sale_number", "user_name",
        F.size("items").alias("n"),
        F.aggregate("items.quantity", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("u"),
        F.aggregate("items.total", F.lit(0).cast("decimal(38,2)"),
                    lambda a, x: (a + x).cast("decimal(38,2)")).alias("t"))
    return per_row.groupBy("id", "sale_number", "user_name").agg(
        F.sum("n").cast("bigint").alias("item_count"), F.sum("u").cast("bigint").alias("units"),
        F.sum("t").cast("double").alias("items_total"))


@register("sale_lines")
def sale_lines(spark, sf):
    """C9 flat: every line with its place in its sale, and the sale's number of lines and user."""
    sh = shop(spark, sf)
    heads, lines = jn.sale_and_lines(sh.sales, sh.sale_items, sh.users)
    heads = heads.select(F.col("id").alias("sale_id"), "sale_number", "user_name", "line_count")
    return lines.join(heads, "sale_id", "right").select(
        "sale_id", "sale_number", "user_name", "line_count", "line_no", "product_id", "quantity", "total")


@register("fk_violations")
def fk_violations(spark, sf):
    sh = shop(spark, sf)
    lines = sh.sale_items.select(F.col("sale_id").alias("request_id"), "product_id")
    newp = sh.products.select(F.col("id").alias("request_id"), "category_id", "supplier_id")
    return jn.fk_violations(lines, sh.products, newp, sh.categories, sh.suppliers)


@register("category_performance")
def category_performance(spark, sf):
    sh = shop(spark, sf)
    return jn.category_performance(sh.sales, sh.sale_items, sh.products, sh.categories, AS_OF, 90)
