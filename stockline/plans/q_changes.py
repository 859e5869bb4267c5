"""Registered table-changing queries (I1-I13). Request frames are derived
from the tables themselves, so the work grows with the data."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from stockline.operators import posting as po
from stockline.operators import snapshots as sn
from stockline.plans.registry import register, shop

NOW = _dt.datetime(2001, 8, 1, 12, 0, 0)


def _lines(sh, status: str | None = None):
    items = sh.sale_items
    if status:
        ids = sh.sales.where(F.col("status") == status).select(F.col("id").alias("sale_id"))
        items = items.join(ids, "sale_id", "left_semi")
    return items.select(F.col("sale_id").alias("request_id"), "product_id", "quantity", "unit_price",
                        "tax_rate", "discount_percent")


@register("priced_lines")
def priced_lines(spark, sf):
    """Every sale line re-priced from its request fields."""
    sh = shop(spark, sf)
    return po.priced_lines(_lines(sh), sh.products)


@register("priced_sales")
def priced_sales(spark, sf):
    """Sale totals from unrounded line amounts."""
    sh = shop(spark, sf)
    headers = sh.sales.select(F.col("id").alias("request_id"), "payment_method", "status", "payment_status")
    return po.priced_sales(_lines(sh), headers, sh.products)


@register("sale_numbers")
def sale_numbers(spark, sf):
    """Number the draft sales after the other sales of their day."""
    sh = shop(spark, sf)
    new = sh.sales.where(F.col("status") == "draft").select(F.col("id").alias("request_id"), "sale_date")
    existing = sh.sales.where(F.col("status") != "draft")
    return po.sale_numbers(new, existing)


@register("stock_check")
def stock_check(spark, sf):
    """Pre-check of the draft sales' lines against stock."""
    sh = shop(spark, sf)
    return po.stock_check(_lines(sh, "draft"), sh.products)


def _post(spark, sf):
    sh = shop(spark, sf)
    headers = sh.sales.where(F.col("status") == "draft").select(F.col("id").alias("request_id"), "sale_date")
    return po.post_sales(_lines(sh, "draft"), headers, sh.products)


@register("post_sales")
def post_sales(spark, sf):
    """I4: post every draft sale against stock, all-or-nothing, in order."""
    return _post(spark, sf)[1]


@register("post_sales_stock")
def post_sales_stock(spark, sf):
    return _post(spark, sf)[0].select("id", "current_stock")


def _post_tables(spark, sf):
    """Draft sales posted as completed ones, beside the sales that exist."""
    sh = shop(spark, sf)
    drafts = sh.sales.where(F.col("status") == "draft")
    headers = drafts.select(F.col("id").alias("request_id"), "customer_name", "payment_method", "payment_status",
                            F.lit("completed").alias("status"), "user_id", "sale_date")
    return po.post_sales_tables(_lines(sh, "draft"), headers, sh.products, sh.sales.where(F.col("status") != "draft"), NOW)


@register("post_sales_rows")
def post_sales_rows(spark, sf):
    """I4: the new rows of sales, with I2's numbers, I1's totals and H17's payment status."""
    return _post_tables(spark, sf).sales.select(
        "id", "sale_number", "customer_name", "total_amount", "tax_amount", "discount_amount", "grand_total", "payment_method",
        "payment_status", "status", "user_id", "sale_date", "created_at")


@register("post_sales_items")
def post_sales_items(spark, sf):
    """I4: the new rows of sale_items."""
    return _post_tables(spark, sf).sale_items


def _cancel(spark, sf):
    sh = shop(spark, sf)
    req = sh.sales.where(F.col("payment_method") == "card").select(F.col("id").alias("request_id"))
    return po.cancel_sales(sh.sales, sh.sale_items, sh.products, req)


@register("cancel_sales")
def cancel_sales(spark, sf):
    """Cancel every card sale (already cancelled ones are refused)."""
    return _cancel(spark, sf)[2]


@register("cancel_sales_stock")
def cancel_sales_stock(spark, sf):
    return _cancel(spark, sf)[1].select("id", "current_stock")


@register("cancel_sales_status")
def cancel_sales_status(spark, sf):
    return _cancel(spark, sf)[0].select("id", "status", "payment_status")


def _patch(spark, sf):
    sh = shop(spark, sf)
    patches = sh.sales.where(F.col("payment_method") == "upi").select(
        F.col("id").alias("request_id"),
        F.upper("customer_name").alias("customer_name"), F.lit(True).alias("set_customer_name"),
        F.lit("priority").alias("notes"), F.lit(True).alias("set_notes"),
        F.lit(None).cast("string").alias("payment_reference"), F.lit(False).alias("set_payment_reference"))
    return po.patch_sales(sh.sales, patches)


@register("patch_sales")
def patch_sales(spark, sf):
    """Patch every upi sale (only drafts accept)."""
    return _patch(spark, sf)[1]


@register("patch_sales_rows")
def patch_sales_rows(spark, sf):
    return _patch(spark, sf)[0].select("id", "customer_name", "notes", "status")


def _delete(spark, sf):
    sh = shop(spark, sf)
    req = sh.sales.where(F.col("payment_method") == "cheque").select(F.col("id").alias("request_id"))
    return po.delete_drafts(sh.sales, sh.sale_items, req)


@register("delete_drafts")
def delete_drafts(spark, sf):
    """Delete every cheque sale that is a draft, with its lines."""
    return _delete(spark, sf)[2]


@register("delete_drafts_remaining")
def delete_drafts_remaining(spark, sf):
    sales, items, _ = _delete(spark, sf)
    return sales.agg(F.count(F.lit(1)).alias("sales_left")).select(
        "sales_left", items.agg(F.count(F.lit(1))).scalar().alias("items_left"))


def _add(spark, sf):
    sh = shop(spark, sf)
    req = sh.products.select(
        F.col("id").alias("request_id"), F.concat("sku", F.lit("-V2")).alias("sku"),
        F.concat("name", F.lit(" v2")).alias("name"), "description", "category_id", "supplier_id",
        "cost_price", "selling_price", "current_stock", "min_stock_level", "max_stock_level", "brand",
        "barcode")
    return sn.add_products(sh.products, sh.categories, sh.suppliers, req, NOW)


@register("add_products")
def add_products(spark, sf):
    """I8: every product resubmitted as a variant; the barcode must be new."""
    return _add(spark, sf)[1]


@register("add_products_new")
def add_products_new(spark, sf):
    sh = shop(spark, sf)
    top = sh.products.agg(F.max("id")).scalar()
    return _add(spark, sf)[0].where(F.col("id") > top).select(
        "id", "sku", "margin", "current_stock", "last_restocked")


def _patch_products(spark, sf):
    sh = shop(spark, sf)
    patches = sh.products.select(
        F.col("id").alias("request_id"),
        (F.col("selling_price") + F.lit(1)).alias("selling_price"), F.lit(True).alias("set_selling_price"),
        F.lit(None).cast("string").alias("description"), (F.col("brand") == "Brand#1").alias("set_description"))
    return sn.patch_products(sh.products, patches)


@register("patch_products")
def patch_products(spark, sf):
    """Raise every price by 1.00; clear Brand#1 descriptions."""
    return _patch_products(spark, sf)[0].select("id", "selling_price", "margin", "description")


@register("adjust_stock")
def adjust_stock(spark, sf):
    """Take min_stock_level units out of every product."""
    sh = shop(spark, sf)
    ch = sh.products.select(F.col("id").alias("request_id"), F.col("id").alias("product_id"),
                            (-F.col("min_stock_level")).alias("quantity"))
    new, result = sn.adjust_stock(sh.products, ch, NOW)
    return result


@register("adjust_stock_rows")
def adjust_stock_rows(spark, sf):
    sh = shop(spark, sf)
    ch = sh.products.select(F.col("id").alias("request_id"), F.col("id").alias("product_id"),
                            (-F.col("min_stock_level")).alias("quantity"))
    return sn.adjust_stock(sh.products, ch, NOW)[0].select("id", "current_stock")


@register("stock_ledger")
def stock_ledger(spark, sf):
    """I10 with many changes of a product: every sale takes its units out, every cancelled one brings them in."""
    sh = shop(spark, sf)
    units = sh.sale_items.groupBy(F.col("sale_id").alias("request_id"), "product_id").agg(F.sum("quantity").alias("units"))
    gone = sh.sales.where(F.col("status") == "cancelled").select(F.col("id").alias("request_id"), F.lit(True).alias("gone"))
    ch = units.join(gone, "request_id", "left").select(
        "request_id", "product_id", F.when(F.col("gone"), F.col("units")).otherwise(-F.col("units")).alias("quantity"))
    return sn.stock_ledger(sh.products, ch)


@register("bulk_stock")
def bulk_stock(spark, sf):
    """Set every product toward 10 - stock; negative results fail."""
    sh = shop(spark, sf)
    ch = sh.products.select(F.col("id").alias("request_id"), F.col("id").alias("product_id"),
                            (F.lit(10) - F.col("current_stock") * 2).alias("quantity"))
    return sn.bulk_stock(sh.products, ch, NOW)[1]


@register("deactivate_products")
def deactivate_products(spark, sf):
    """Deactivate every out-of-stock product."""
    sh = shop(spark, sf)
    req = sh.products.where(F.col("current_stock") == 0).select(F.col("id").alias("request_id"))
    return sn.deactivate_products(sh.products, req)[0].select("id", "is_active")


@register("merge_dimension")
def merge_dimension(spark, sf):
    """Every brand becomes a category, an existing type name is refused,
    and category 3 is deleted (its products lose the link)."""
    sh = shop(spark, sf)
    brands = sh.products.select(F.col("brand").alias("name")).distinct()
    creates = brands.select(F.substring("name", 7, 10).cast("bigint").alias("request_id"), "name",
                            F.concat(F.lit("Brand "), "name").alias("description")).unionByName(
        sh.categories.where(F.col("id") == 1).select(F.lit(1000).cast("bigint").alias("request_id"), "name",
                                                    F.lit("again").alias("description")))
    deletes = sh.categories.where(F.col("id") == 3).select(F.col("id").alias("request_id"))
    cats, prods, result = sn.merge_dimension(sh.categories, sh.products, "category", creates=creates,
                                             deletes=deletes, now=NOW)
    return result


@register("merge_dimension_rows")
def merge_dimension_rows(spark, sf):
    sh = shop(spark, sf)
    brands = sh.products.select(F.col("brand").alias("name")).distinct()
    creates = brands.select(F.substring("name", 7, 10).cast("bigint").alias("request_id"), "name",
                            F.concat(F.lit("Brand "), "name").alias("description"))
    deletes = sh.categories.where(F.col("id") == 3).select(F.col("id").alias("request_id"))
    cats, prods, _ = sn.merge_dimension(sh.categories, sh.products, "category", creates=creates,
                                        deletes=deletes, now=NOW)
    return cats.select("id", "name", "description")
