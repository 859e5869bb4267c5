"""Registered sales queries."""

from __future__ import annotations

from stockline.operators import sales as op
from stockline.plans.registry import AS_OF, FULL_END, FULL_START, register, shop


def _s(spark, sf):
    sh = shop(spark, sf)
    return sh.sales, sh.sale_items


@register("sales_by_day")
def sales_by_day(spark, sf):
    return op.sales_by_period(*_s(spark, sf), FULL_START, FULL_END, "day")


@register("sales_by_week")
def sales_by_week(spark, sf):
    return op.sales_by_period(*_s(spark, sf), FULL_START, FULL_END, "week")


@register("sales_by_month")
def sales_by_month(spark, sf):
    return op.sales_by_period(*_s(spark, sf), FULL_START, FULL_END, "month")


@register("sales_all")
def sales_all(spark, sf):
    return op.sales_by_period(*_s(spark, sf), FULL_START, FULL_END, "category")


@register("sales_by_product")
def sales_by_product(spark, sf):
    return op.sales_by_product(*_s(spark, sf), FULL_START, FULL_END)


@register("sales_period_summary")
def sales_period_summary(spark, sf):
    return op.sales_period_summary(*_s(spark, sf), FULL_START, FULL_END)


@register("payment_method_counts")
def payment_method_counts(spark, sf):
    return op.payment_method_counts(shop(spark, sf).sales, FULL_START, FULL_END)


@register("sales_report_totals")
def sales_report_totals(spark, sf):
    return op.sales_report_totals(*_s(spark, sf), FULL_START, FULL_END, "day")


@register("sales_by_product_summary")
def sales_by_product_summary(spark, sf):
    return op.sales_by_product_summary(*_s(spark, sf), FULL_START, FULL_END)


@register("daily_sales")
def daily_sales(spark, sf):
    return op.daily_sales(shop(spark, sf).sales, AS_OF, 30)


@register("sales_by_product_id")
def sales_by_product_id(spark, sf):
    return op.sales_by_product_id(*_s(spark, sf))


@register("sales_by_product_id_totals")
def sales_by_product_id_totals(spark, sf):
    return op.sales_by_product_id_totals(*_s(spark, sf))


@register("sales_summary")
def sales_summary(spark, sf):
    return op.sales_summary(shop(spark, sf).sales, AS_OF)


@register("most_sold_30d")
def most_sold_30d(spark, sf):
    return op.most_sold(*_s(spark, sf), AS_OF, 30, 10)


@register("sales_daily_report")
def sales_daily_report(spark, sf):
    return op.sales_daily_report(*_s(spark, sf), AS_OF, 30)


@register("sales_monthly_report")
def sales_monthly_report(spark, sf):
    return op.sales_monthly_report(*_s(spark, sf), AS_OF, 6)


@register("quick_sales")
def quick_sales(spark, sf):
    return op.quick_sales(shop(spark, sf).sales, AS_OF, 30)


@register("quick_top5")
def quick_top5(spark, sf):
    return op.quick_top(*_s(spark, sf), AS_OF, 30, 5)


@register("trend_7d")
def trend_7d(spark, sf):
    return op.trend(shop(spark, sf).sales, AS_OF, 7)


@register("top_by_quantity")
def top_by_quantity(spark, sf):
    return op.top_by_quantity(*_s(spark, sf), AS_OF, 30, 10)


@register("top_by_revenue")
def top_by_revenue(spark, sf):
    return op.top_by_revenue(*_s(spark, sf), AS_OF, 30, 10)


@register("top_products_report")
def top_products_report(spark, sf):
    return op.top_products_report(*_s(spark, sf), AS_OF, 30, 10)


@register("recent_sales")
def recent_sales(spark, sf):
    return op.recent_sales(shop(spark, sf).sales, 5)


@register("recent_revenue")
def recent_revenue(spark, sf):
    sh = shop(spark, sf)
    return op.recent_revenue(sh.sales, sh.products, 5, 100)


@register("chart_revenue")
def chart_revenue(spark, sf):
    """Chart data of the sales report (period, revenue)."""
    return op.sales_by_period(*_s(spark, sf), FULL_START, FULL_END, "day").select("period", "total_revenue")
