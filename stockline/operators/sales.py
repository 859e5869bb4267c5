"""Sales reports: D1-D17 and the top-k family F4-F10.

Inputs are the ``sales`` and ``sale_items`` frames (see :mod:`stockline.schema`);
every function returns a DataFrame plan. Money stays decimal through every
sum and becomes a double only at the end, so sums are exact and do not depend
on partitioning. All rolling windows take an explicit ``as_of``.

Plan shape, for scale:
- the date/status filter is applied to ``sales`` first and reaches the parquet
  scan as a pushed filter;
- lines per sale (D1-D4, D6, D8, D13, D14) are counted first and joined as counts: no join
  ever sees the lines of a hot sale;
- other line-level measures are taken from ``sale_items`` semi-joined to the
  filtered sales, so lines of other sales are dropped before any aggregation
  shuffle (and the semi join can become a broadcast or a runtime bloom filter
  when the filtered side is small);
- every aggregate is a partial + final hash aggregate, so a hot key (one day,
  one product with a third of all rows) is combined map-side and never lands
  whole in one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions.exprs import (as_of_parts, date_lit, day_of, mean_money, month_key,
                                       ratio, to_double, ts_lit, week_key)

GROUPINGS = ("day", "week", "month", "product")


# ---------------------------------------------------------------- B15 / B16 / C10

def completed_between(sales: DataFrame, start: _dt.date | None, end: _dt.date | None) -> DataFrame:
    """Completed sales whose calendar date lies in [start, end] (each bound optional)."""
    cond = F.col("status") == F.lit("completed")
    d = day_of("sale_date")
    if start:
        cond = cond & (d >= date_lit(start))
    if end:
        cond = cond & (d <= date_lit(end))
    if "sale_month" in sales.columns:
        # Stored layout (sources.store): the implied month range prunes partitions.
        if start:
            cond = cond & (F.col("sale_month") >= F.lit(f"{start.year:04d}-{start.month:02d}"))
        if end:
            cond = cond & (F.col("sale_month") <= F.lit(f"{end.year:04d}-{end.month:02d}"))
    return sales.where(cond)


def rolling_window(as_of: _dt.date | _dt.datetime, days: int) -> tuple[_dt.date, _dt.date]:
    """[as_of - days, as_of], both ends in (days + 1 calendar days)."""
    if not 1 <= days <= 365:
        raise ValueError("days must be within 1..365")
    today, _ = as_of_parts(as_of)
    return today - _dt.timedelta(days=days), today


def line_counts(sale_items: DataFrame) -> DataFrame:
    """Number of item rows per sale (lines, not units). Lines are combined in the tasks that read them, so a
    sale that holds a third of all lines is one row a task in the shuffle."""
    return sale_items.groupBy("sale_id").agg(F.count(F.lit(1)).alias("items_count"))


def _lines_of(sale_items: DataFrame, sales: DataFrame) -> DataFrame:
    return sale_items.join(sales.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")


# ---------------------------------------------------------------- D1-D4, D6-D8

def period_key(group_by: str, ts: str = "sale_date"):
    d = day_of(ts)
    if group_by == "day":
        return d
    if group_by == "week":
        return week_key(d)
    if group_by == "month":
        return month_key(d)
    return F.lit("All")  # D4: any other value is one group


def _per_sale(sales: DataFrame, sale_items: DataFrame, start, end, extra: tuple = ()) -> DataFrame:
    s = completed_between(sales, start, end).select("id", "sale_date", "grand_total", *extra)
    counts = line_counts(sale_items)
    return (s.join(counts, s.id == counts.sale_id, "left")
             .withColumn("items_count", F.coalesce(F.col("items_count"), F.lit(0)))
             .drop("sale_id"))


def _period_decimal(sales, sale_items, start, end, group_by) -> DataFrame:
    per_sale = _per_sale(sales, sale_items, start, end)
    return (per_sale.groupBy(period_key(group_by).alias("period"))
            .agg(F.count(F.lit(1)).alias("sales_count"),
                 F.sum("grand_total").alias("revenue"),
                 F.sum("items_count").alias("total_items")))


def sales_by_period(sales: DataFrame, sale_items: DataFrame, start: _dt.date, end: _dt.date,
                    group_by: str = "day") -> DataFrame:
    """Completed sales in [start, end] grouped by day / week / month /
    anything else ("All"): sales_count, total_revenue, avg_order_value (half up
    to the cent), total_items (line rows). ``product`` gives D5."""
    if group_by == "product":
        return sales_by_product(sales, sale_items, start, end)
    g = _period_decimal(sales, sale_items, start, end, group_by)
    return (g.select("period", "sales_count",
                     to_double("revenue").alias("total_revenue"),
                     mean_money("revenue", "sales_count").alias("avg_order_value"),
                     F.col("total_items").cast("bigint").alias("total_items"))
             .orderBy("period"))


def sales_period_summary(sales: DataFrame, sale_items: DataFrame, start: _dt.date,
                         end: _dt.date) -> DataFrame:
    """One row over the whole period (zeros / NULLs when it is empty)."""
    per_sale = _per_sale(sales, sale_items, start, end, extra=("customer_name",))
    return per_sale.agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.coalesce(to_double(F.sum("grand_total")), F.lit(0.0)).alias("total_revenue"),
        ratio(F.sum("grand_total"), F.count(F.lit(1))).alias("avg_order_value"),
        to_double(F.max("grand_total")).alias("max_order"),
        to_double(F.min("grand_total")).alias("min_order"),
        F.count_distinct("customer_name").alias("total_customers"),
        F.coalesce(F.sum("items_count"), F.lit(0)).cast("bigint").alias("total_products_sold"),
    ).withColumn("days", F.lit((end - start).days + 1))


def payment_method_counts(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Completed sales per payment method."""
    return (completed_between(sales, start, end).groupBy("payment_method")
            .agg(F.count(F.lit(1)).alias("sales_count")))


def payment_method_map(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """D7 in its dictionary form: one row, ``map<string,bigint>``. The map has
    one entry per method (a handful), so collecting it into one row is bounded."""
    counts = payment_method_counts(sales, start, end)
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("payment_method", "sales_count")))).alias("payment_methods"))


def sales_report_totals(sales: DataFrame, sale_items: DataFrame, start: _dt.date, end: _dt.date,
                        group_by: str = "day") -> DataFrame:
    """Endpoint totals over the grouped rows of D1-D4."""
    g = _period_decimal(sales, sale_items, start, end, group_by)
    return g.agg(
        F.coalesce(F.sum("sales_count"), F.lit(0)).cast("bigint").alias("total_sales"),
        F.coalesce(to_double(F.sum("revenue")), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("total_items"), F.lit(0)).cast("bigint").alias("total_products_sold"),
        ratio(F.sum("revenue"), F.sum("sales_count")).alias("average_order_value"),
    )


# ---------------------------------------------------------------- D5, D9, D11

def _by_product_decimal(sales, sale_items, start, end, keys) -> DataFrame:
    lines = _lines_of(sale_items, completed_between(sales, start, end))
    return lines.groupBy(*keys).agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum("total").alias("revenue"),
        F.sum("unit_price").alias("price_sum"),
        F.count(F.lit(1)).alias("n_lines"))


def sales_by_product(sales: DataFrame, sale_items: DataFrame, start: _dt.date,
                     end: _dt.date) -> DataFrame:
    """Per (product_name, product_sku): total_quantity, total_revenue
    (sum of line totals), avg_price (plain mean of unit_price over lines);
    revenue descending (ties by name, sku)."""
    g = _by_product_decimal(sales, sale_items, start, end, ("product_name", "product_sku"))
    return (g.select("product_name", "product_sku",
                     F.col("total_quantity").cast("bigint").alias("total_quantity"),
                     to_double("revenue").alias("total_revenue"),
                     ratio("price_sum", "n_lines").alias("avg_price"),
                     F.col("revenue").alias("_rev"))
             .orderBy(F.desc("_rev"), "product_name", "product_sku").drop("_rev"))


def sales_by_product_summary(sales: DataFrame, sale_items: DataFrame, start: _dt.date,
                             end: _dt.date) -> DataFrame:
    """Products, total quantity, total revenue, and the top row of D5."""
    g = _by_product_decimal(sales, sale_items, start, end, ("product_name", "product_sku"))
    order_key = F.struct((-F.col("revenue")).alias("r"), "product_name", "product_sku")
    return g.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(F.sum("total_quantity"), F.lit(0)).cast("bigint").alias("total_quantity"),
        F.coalesce(to_double(F.sum("revenue")), F.lit(0.0)).alias("total_revenue"),
        F.min_by("product_name", order_key).alias("top_product"),
        to_double(F.max("revenue")).alias("top_product_revenue"),
    )


def sales_by_product_id(sales: DataFrame, sale_items: DataFrame, product_id: int | None = None,
                        start: _dt.date | None = None, end: _dt.date | None = None) -> DataFrame:
    """Per (product_id, name, sku), completed sales, optional product and
    date filters (a 0 / empty filter means none); quantity descending."""
    items = sale_items.where(F.col("product_id") == F.lit(product_id)) if product_id else sale_items
    g = _by_product_decimal(sales, items, start, end, ("product_id", "product_name", "product_sku"))
    return (g.select("product_id", "product_name", "product_sku",
                     F.col("total_quantity").cast("bigint").alias("total_quantity"),
                     to_double("revenue").alias("total_revenue"),
                     ratio("price_sum", "n_lines").alias("avg_price"))
             .orderBy(F.desc("total_quantity"), "product_id", "product_name", "product_sku"))


def sales_by_product_id_totals(sales, sale_items, product_id=None, start=None, end=None) -> DataFrame:
    """D11 endpoint totals: rows, total quantity, total revenue."""
    items = sale_items.where(F.col("product_id") == F.lit(product_id)) if product_id else sale_items
    g = _by_product_decimal(sales, items, start, end, ("product_id", "product_name", "product_sku"))
    return g.agg(F.count(F.lit(1)).alias("total_products"),
                 F.coalesce(F.sum("total_quantity"), F.lit(0)).cast("bigint").alias("total_quantity"),
                 F.coalesce(to_double(F.sum("revenue")), F.lit(0.0)).alias("total_revenue"))


def top_by_quantity(sales, sale_items, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    """top-N of D11 over the window by quantity."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    start, end = rolling_window(as_of, days)
    return sales_by_product_id(sales, sale_items, None, start, end).limit(limit)


def top_by_revenue(sales, sale_items, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    """top-N by revenue; ties keep the quantity order (a stable re-sort)."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    start, end = rolling_window(as_of, days)
    items = sale_items
    g = _by_product_decimal(sales, items, start, end, ("product_id", "product_name", "product_sku"))
    return (g.select("product_id", "product_name", "product_sku",
                     F.col("total_quantity").cast("bigint").alias("total_quantity"),
                     to_double("revenue").alias("total_revenue"),
                     ratio("price_sum", "n_lines").alias("avg_price"),
                     F.col("revenue").alias("_rev"))
             .orderBy(F.desc("_rev"), F.desc("total_quantity"), "product_id", "product_name",
                      "product_sku")
             .limit(limit).drop("_rev"))


def top_products_report(sales, sale_items, as_of, days: int = 30, limit: int = 10) -> DataFrame:
    """F8: D5 over the rolling window, first ``limit`` rows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    start, end = rolling_window(as_of, days)
    return sales_by_product(sales, sale_items, start, end).limit(limit)


# ---------------------------------------------------------------- D10, D12-D17

def daily_sales(sales: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per calendar day in the window: sales_count, total_revenue (days
    without sales are absent)."""
    start, end = rolling_window(as_of, days)
    return (completed_between(sales, start, end)
            .groupBy(day_of("sale_date").alias("date"))
            .agg(F.count(F.lit(1)).alias("sales_count"),
                 to_double(F.sum("grand_total")).alias("total_revenue"))
            .orderBy("date"))


def sales_summary(sales: DataFrame, as_of) -> DataFrame:
    """All-time completed count / revenue / average and today's count /
    revenue, in one pass over the sales."""
    today, _ = as_of_parts(as_of)
    done = sales.where(F.col("status") == "completed")
    is_today = day_of("sale_date") == date_lit(today)
    return done.agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.coalesce(to_double(F.sum("grand_total")), F.lit(0.0)).alias("total_revenue"),
        ratio(F.sum("grand_total"), F.count(F.lit(1))).alias("avg_order_value"),
        F.count_if(is_today).alias("today_sales"),
        F.coalesce(to_double(F.sum(F.when(is_today, F.col("grand_total")))), F.lit(0.0)).alias("today_revenue"),
    )


def most_sold(sales: DataFrame, sale_items: DataFrame, as_of, days: int = 30,
              limit: int = 10) -> DataFrame:
    """Product names by quantity over completed sales with
    ``sale_date >= now - days`` (timestamp bound, no upper bound)."""
    _, now = as_of_parts(as_of)
    recent = sales.where((F.col("status") == "completed")
                         & (F.col("sale_date") >= ts_lit(now - _dt.timedelta(days=days))))
    g = _lines_of(sale_items, recent).groupBy("product_name").agg(
        F.sum("quantity").alias("quantity"), F.sum("total").alias("revenue"))
    return (g.select(F.col("product_name").alias("name"),
                     F.col("quantity").cast("bigint").alias("quantity"),
                     to_double("revenue").alias("revenue"))
             .orderBy(F.desc("quantity"), "name").limit(limit))


def sales_daily_report(sales, sale_items, as_of, days: int = 30) -> DataFrame:
    """D1 by day over the rolling window."""
    start, end = rolling_window(as_of, days)
    return sales_by_period(sales, sale_items, start, end, "day")


def monthly_window(as_of, months: int) -> tuple[_dt.date, _dt.date]:
    """H7: first of the as-of month minus 30 x months days, to as-of."""
    if not 1 <= months <= 24:
        raise ValueError("months must be within 1..24")
    today, _ = as_of_parts(as_of)
    return today.replace(day=1) - _dt.timedelta(days=30 * months), today


def sales_monthly_report(sales, sale_items, as_of, months: int = 6) -> DataFrame:
    """D3 by month from the H7 bound."""
    start, end = monthly_window(as_of, months)
    return sales_by_period(sales, sale_items, start, end, "month")


def quick_sales(sales: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Count, revenue, average over the rolling window, one pass."""
    start, end = rolling_window(as_of, days)
    s = completed_between(sales, start, end)
    return s.agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.coalesce(to_double(F.sum("grand_total")), F.lit(0.0)).alias("total_revenue"),
        ratio(F.sum("grand_total"), F.count(F.lit(1))).alias("avg_order_value"),
    ).withColumn("days", F.lit(days))


def quick_top(sales: DataFrame, sale_items: DataFrame, as_of, days: int = 30, limit: int = 5) -> DataFrame:
    """Top product names by quantity over the rolling window."""
    start, end = rolling_window(as_of, days)
    g = _lines_of(sale_items, completed_between(sales, start, end)).groupBy("product_name").agg(
        F.sum("quantity").alias("quantity"))
    return (g.select(F.col("product_name").alias("product"),
                     F.col("quantity").cast("bigint").alias("quantity"))
             .orderBy(F.desc("quantity"), "product").limit(limit))


def trend(sales: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Completed sales per day for the ``days`` days before as-of (as-of
    itself not included), zero-filled. The calendar has ``days`` rows."""
    today, _ = as_of_parts(as_of)
    start, end = today - _dt.timedelta(days=days), today - _dt.timedelta(days=1)
    counts = (completed_between(sales, start, end)
              .groupBy(day_of("sale_date").alias("date")).agg(F.count(F.lit(1)).alias("n")))
    spark = sales.sparkSession
    calendar = spark.range(1, days + 1, numPartitions=1).select(
        F.date_sub(date_lit(today), F.col("id").cast("int")).alias("date"))
    return (calendar.join(counts, "date", "left")
            .select("date", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("sales"))
            .orderBy("date"))


# ---------------------------------------------------------------- F9, D25

def recent_sales(sales: DataFrame, limit: int = 5) -> DataFrame:
    """latest sales, newest first (NULL dates first, as PostgreSQL DESC)."""
    return (sales.orderBy(F.desc_nulls_first("sale_date"), F.desc("id"))
            .limit(limit)
            .select("id", "sale_number", "customer_name", to_double("grand_total").alias("grand_total"),
                    "status", "sale_date"))


def recent_revenue(sales: DataFrame, products: DataFrame, sales_limit: int = 5,
                   products_limit: int = 100) -> DataFrame:
    """Page cards: products listed (first page of the active list), sales
    listed and the sum of their grand totals."""
    latest = sales.orderBy(F.desc_nulls_first("sale_date"), F.desc("id")).limit(sales_limit)
    cards = latest.agg(F.count(F.lit(1)).alias("sales_listed"),
                       F.coalesce(to_double(F.sum("grand_total")), F.lit(0.0)).alias("recent_revenue"))
    listed = products.where(F.col("is_active") == F.lit(True)).agg(
        F.least(F.count(F.lit(1)), F.lit(products_limit)).cast("bigint").alias("products_listed"))
    # Two one-row aggregates side by side through scalar subqueries (no join).
    return listed.select("products_listed",
                         cards.select("sales_listed").scalar().alias("sales_listed"),
                         cards.select("recent_revenue").scalar().alias("recent_revenue"))
