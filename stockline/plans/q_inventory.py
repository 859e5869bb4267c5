"""Registered inventory and product-report queries."""

from __future__ import annotations

from stockline.operators import inventory as op
from stockline.plans.registry import register, shop


def _d(spark, sf):
    sh = shop(spark, sf)
    return sh.products, sh.categories, sh.suppliers


@register("inventory_summary")
def inventory_summary(spark, sf):
    return op.inventory_summary(shop(spark, sf).products)


for _t in op.REPORT_TYPES:
    _name = "inventory_report" if _t == "stock_summary" else f"inventory_report_{_t}"
    register(_name)(lambda spark, sf, _t=_t: op.inventory_report(*_d(spark, sf), _t))


@register("inventory_report_summary")
def inventory_report_summary(spark, sf):
    return op.inventory_report_summary(shop(spark, sf).products, "stock_summary")


@register("inventory_report_summary_low_stock")
def inventory_report_summary_low(spark, sf):
    return op.inventory_report_summary(shop(spark, sf).products, "low_stock")


@register("stock_status_counts")
def stock_status_counts(spark, sf):
    return op.stock_status_counts(shop(spark, sf).products)


@register("quick_inventory")
def quick_inventory(spark, sf):
    return op.quick_inventory(shop(spark, sf).products)


@register("category_distribution")
def category_distribution(spark, sf):
    sh = shop(spark, sf)
    return op.category_distribution(sh.categories, sh.products)


@register("product_report")
def product_report(spark, sf):
    return op.product_report(*_d(spark, sf))


@register("product_report_filtered")
def product_report_filtered(spark, sf):
    """Category 3 (MEDIUM), inactive products included."""
    return op.product_report(*_d(spark, sf), category_id=3, include_inactive=True)


@register("product_report_summary")
def product_report_summary(spark, sf):
    return op.product_report_summary(*_d(spark, sf))


@register("product_report_summary_all")
def product_report_summary_all(spark, sf):
    return op.product_report_summary(*_d(spark, sf), include_inactive=True)
