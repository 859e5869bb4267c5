"""Inventory and product reports: D18-D24, C3 and the A7 chart data.

The dimension joins (categories, suppliers) are plain left joins: both sides
are left to the planner, which broadcasts a dimension only when its measured
size is under the broadcast threshold (statically from file sizes, or at run
time through AQE) and otherwise shuffles; nothing is broadcast unchecked.
Every summary is one aggregate pass with ``count_if`` / conditional sums
instead of one query per number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions.exprs import (margin_percent, or_na, ratio, stock_status, stock_value,
                                       to_double)

REPORT_TYPES = ("stock_summary", "low_stock", "out_of_stock", "slow_moving")


def active(products: DataFrame) -> DataFrame:
    """``is_active == True``: NULL is not active."""
    return products.where(F.col("is_active") == F.lit(True))


def _typed(products: DataFrame, report_type: str) -> DataFrame:
    p = active(products)
    if report_type == "low_stock":
        return p.where(F.col("current_stock") <= F.col("min_stock_level"))
    if report_type == "out_of_stock":
        return p.where(F.col("current_stock") == 0)
    if report_type == "slow_moving":
        # The reference's "simplified" rule: stock on hand, sales not consulted.
        return p.where(F.col("current_stock") > 0)
    return p


def with_names(products: DataFrame, categories: DataFrame, suppliers: DataFrame,
               na: bool = True) -> DataFrame:
    """C2 core: add ``category`` / ``supplier`` names by the product's keys.
    ``na=True`` gives the reports' 'N/A' label (H9), else NULL."""
    cat = categories.select(F.col("id").alias("_cat_id"), F.col("name").alias("_cat_name"))
    sup = suppliers.select(F.col("id").alias("_sup_id"), F.col("name").alias("_sup_name"))
    j = (products.join(cat, products.category_id == cat._cat_id, "left")
         .join(sup, products.supplier_id == sup._sup_id, "left"))
    if na:
        j = j.withColumn("category", or_na("_cat_name", "_cat_id")).withColumn(
            "supplier", or_na("_sup_name", "_sup_id"))
    else:
        j = j.withColumn("category", F.col("_cat_name")).withColumn("supplier", F.col("_sup_name"))
    return j.drop("_cat_id", "_cat_name", "_sup_id", "_sup_name")


# ---------------------------------------------------------------- D18

def inventory_summary(products: DataFrame) -> DataFrame:
    """Active products, units, stock value at cost and at price, low and
    out-of-stock counts; one pass, zeros when empty."""
    p = active(products)
    return p.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(F.sum("current_stock"), F.lit(0)).cast("bigint").alias("total_stock"),
        F.coalesce(to_double(F.sum(stock_value("current_stock", "cost_price"))), F.lit(0.0))
         .alias("total_inventory_value"),
        F.coalesce(to_double(F.sum(stock_value("current_stock", "selling_price"))), F.lit(0.0))
         .alias("total_potential_revenue"),
        F.count_if(F.col("current_stock") <= F.col("min_stock_level")).alias("low_stock_count"),
        F.count_if(F.col("current_stock") == 0).alias("out_of_stock_count"),
    )


# ---------------------------------------------------------------- D19, D20

def inventory_report(products: DataFrame, categories: DataFrame, suppliers: DataFrame,
                     report_type: str = "stock_summary") -> DataFrame:
    """One row per active product of the report type with names, values
    and stock status (H2)."""
    p = with_names(_typed(products, report_type), categories, suppliers)
    return p.select(
        F.col("id").alias("product_id"), "sku", "name", "category", "supplier",
        "current_stock", "min_stock_level", "max_stock_level",
        to_double("cost_price").alias("cost_price"),
        to_double("selling_price").alias("selling_price"),
        to_double(stock_value("current_stock", "cost_price")).alias("stock_value"),
        to_double(stock_value("current_stock", "selling_price")).alias("selling_value"),
        stock_status("current_stock", "min_stock_level").alias("stock_status"),
    )


def inventory_report_summary(products: DataFrame, report_type: str = "stock_summary") -> DataFrame:
    """Summary of D19 (no name joins needed). Over-stock here is
    ``stock > max`` (unlike H2's 2 x min)."""
    p = _typed(products, report_type)
    return p.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(F.sum("current_stock"), F.lit(0)).cast("bigint").alias("total_stock_units"),
        F.coalesce(to_double(F.sum(stock_value("current_stock", "cost_price"))), F.lit(0.0))
         .alias("total_stock_value"),
        F.coalesce(to_double(F.sum(stock_value("current_stock", "selling_price"))), F.lit(0.0))
         .alias("total_selling_value"),
        F.avg(F.col("current_stock").cast("double")).alias("avg_stock_level"),
        F.count_if(F.col("current_stock") <= F.col("min_stock_level")).alias("low_stock_count"),
        F.count_if(F.col("current_stock") == 0).alias("out_of_stock_count"),
        F.count_if(F.col("current_stock") > F.col("max_stock_level")).alias("over_stock_count"),
    )


def stock_status_counts(products: DataFrame, report_type: str = "stock_summary") -> DataFrame:
    """Products per stock status, most first (the chart's status table)."""
    p = _typed(products, report_type)
    return (p.groupBy(stock_status("current_stock", "min_stock_level").alias("stock_status"))
            .agg(F.count(F.lit(1)).alias("product_count"))
            .orderBy(F.desc("product_count"), "stock_status"))


# ---------------------------------------------------------------- D21, C3

def quick_inventory(products: DataFrame) -> DataFrame:
    """Active count, stock value, low and out-of-stock counts."""
    p = active(products)
    return p.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(to_double(F.sum(stock_value("current_stock", "cost_price"))), F.lit(0.0))
         .alias("total_stock_value"),
        F.count_if(F.col("current_stock") <= F.col("min_stock_level")).alias("low_stock_count"),
        F.count_if(F.col("current_stock") == 0).alias("out_of_stock_count"),
    )


def category_distribution(categories: DataFrame, products: DataFrame) -> DataFrame:
    """Products per category, inactive ones included, empty categories 0.
    Products are counted per key first (a partial aggregate per task), so
    only one row per category reaches the join."""
    counts = (products.where(F.col("category_id").isNotNull())
              .groupBy("category_id").agg(F.count(F.lit(1)).alias("n")))
    j = categories.join(counts, categories.id == counts.category_id, "left")
    return (j.groupBy(F.col("name").alias("category"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("product_count")))


# ---------------------------------------------------------------- D22-D24

def _product_filter(products, category_id, supplier_id, include_inactive):
    p = products if include_inactive else active(products)
    if category_id:
        p = p.where(F.col("category_id") == F.lit(category_id))
    if supplier_id:
        p = p.where(F.col("supplier_id") == F.lit(supplier_id))
    return p


def product_report(products: DataFrame, categories: DataFrame, suppliers: DataFrame,
                   category_id: int | None = None, supplier_id: int | None = None,
                   include_inactive: bool = False) -> DataFrame:
    """Product rows with names, margin % (H1) and stock value."""
    p = with_names(_product_filter(products, category_id, supplier_id, include_inactive),
                   categories, suppliers)
    return p.select(
        F.col("id").alias("product_id"), "sku", "name", "description", "category", "supplier",
        "brand", "model", "current_stock",
        to_double("cost_price").alias("cost_price"),
        to_double("selling_price").alias("selling_price"),
        margin_percent("selling_price", "cost_price").alias("margin_percent"),
        to_double(stock_value("current_stock", "cost_price")).alias("stock_value"),
        "is_active", "last_restocked", "created_at",
    )


def product_report_summary(products: DataFrame, categories: DataFrame, suppliers: DataFrame,
                           category_id: int | None = None, supplier_id: int | None = None,
                           include_inactive: bool = False) -> DataFrame:
    """D23 + D24: counts, stock value, mean cost / price (D24's average price is
    ``avg_selling_price``), mean margin over products with a margin, and the
    number of distinct category / supplier labels ('N/A' counts as one).
    Margins are averaged as 4-place decimals so the mean does not depend on
    summation order."""
    p = with_names(_product_filter(products, category_id, supplier_id, include_inactive),
                   categories, suppliers)
    m = margin_percent("selling_price", "cost_price").cast("decimal(24,4)")
    return p.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("is_active") == F.lit(True)).alias("active_products"),
        F.coalesce(to_double(F.sum(stock_value("current_stock", "cost_price"))), F.lit(0.0))
         .alias("total_stock_value"),
        ratio(F.sum("cost_price"), F.count(F.lit(1))).alias("avg_cost_price"),
        ratio(F.sum("selling_price"), F.count(F.lit(1))).alias("avg_selling_price"),
        F.when(F.count(m) > 0, F.sum(m).cast("double") / F.count(m).cast("double")).alias("avg_margin"),
        F.count_distinct("category").alias("categories_count"),
        F.count_distinct("supplier").alias("suppliers_count"),
    )
