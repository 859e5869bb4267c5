"""Registered data-quality queries (J1-J8, C11) over the whole tables, as they are and damaged
(:mod:`stockline.sources.dirty`), where every rule has rows to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline.operators import joins as jn
from stockline.operators import quality as dq
from stockline.plans.registry import register, shop
from stockline.sources.dirty import dirty_shop


@register("dq_product_checks")
def dq_product_checks(spark, sf):
    return dq.dq_product_checks(shop(spark, sf).products)


@register("dq_product_fields")
def dq_product_fields(spark, sf):
    return dq.dq_product_fields(shop(spark, sf).products)


@register("dq_unique")
def dq_unique(spark, sf):
    return dq.dq_unique(dq.all_tables(shop(spark, sf)))


@register("dq_foreign_keys")
def dq_foreign_keys(spark, sf):
    sh = shop(spark, sf)
    return dq.dq_foreign_keys(sh.products, sh.categories, sh.suppliers, sh.sales, sh.sale_items, sh.users)


@register("dq_sale_lines")
def dq_sale_lines(spark, sf):
    sh = shop(spark, sf)
    return dq.dq_sale_lines(sh.sales, sh.sale_items)


@register("dq_sales")
def dq_sales(spark, sf):
    return dq.dq_sales(shop(spark, sf).sales)


@register("dq_suppliers")
def dq_suppliers(spark, sf):
    return dq.dq_suppliers(shop(spark, sf).suppliers)


@register("dq_not_null")
def dq_not_null(spark, sf):
    return dq.dq_not_null(dq.all_tables(shop(spark, sf)))


def _dirty(name, rule):
    register(name)(lambda spark, sf: rule(dirty_shop(shop(spark, sf))))


_dirty("dq_dirty_product_checks", lambda sh: dq.dq_product_checks(sh.products))
_dirty("dq_dirty_product_fields", lambda sh: dq.dq_product_fields(sh.products))
_dirty("dq_dirty_unique", lambda sh: dq.dq_unique(dq.all_tables(sh)))
_dirty("dq_dirty_foreign_keys", lambda sh: dq.dq_foreign_keys(sh.products, sh.categories, sh.suppliers, sh.sales, sh.sale_items, sh.users))
_dirty("dq_dirty_sale_lines", lambda sh: dq.dq_sale_lines(sh.sales, sh.sale_items))
_dirty("dq_dirty_sales", lambda sh: dq.dq_sales(sh.sales))
_dirty("dq_dirty_suppliers", lambda sh: dq.dq_suppliers(sh.suppliers))
_dirty("dq_dirty_not_null", lambda sh: dq.dq_not_null(dq.all_tables(sh)))


@register("fk_violations_dirty")
def fk_violations_dirty(spark, sf):
    """C11 on damaged tables."""
    sh = dirty_shop(shop(spark, sf))
    lines = sh.sale_items.select(F.col("sale_id").alias("request_id"), "product_id")
    newp = sh.products.select(F.col("id").alias("request_id"), "category_id", "supplier_id")
    return jn.fk_violations(lines, sh.products, newp, sh.categories, sh.suppliers)
