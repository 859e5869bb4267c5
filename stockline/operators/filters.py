"""Filters, lookups, lists and search: B1-B19 with paging and ordering F1-F3.

Lookups are re-aimed from "one key" to "a frame of keys": a ``left_semi``
join keeps the matching rows of the big table without duplicating them and
without pulling keys to the driver; the planner broadcasts the key frame
when it is measured small and shuffles otherwise. A single key is just a
one-row key frame, or a plain ``where`` (:func:`by_value`).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions.exprs import (active_label, contains_ci, customer_label, date_lit,
                                       day_of, display_name, reorder_flag, to_double, ts_lit)

PRODUCT_KEYS = ("id", "sku", "barcode")
SALE_KEYS = ("id", "sale_number")
CATEGORY_KEYS = ("id", "name")
SUPPLIER_KEYS = ("id", "name", "email")


# ---------------------------------------------------------------- F1

DEEP_PAGE = 100_000


def page(df: DataFrame, order: list, skip: int = 0, limit: int | None = None,
         deep_page: int = DEEP_PAGE) -> DataFrame:
    """``ORDER BY order OFFSET skip LIMIT limit`` (limit 1..1000, or None
    for the whole ordered list). The reference pages without an ORDER BY;
    here the key always orders, so a page is repeatable.

    A near page is a top-k (each task keeps skip + limit rows). From
    ``deep_page`` rows on, and for an offset without a limit, rows are numbered
    by a range-partitioned running count instead (:mod:`stockline.plans.ordered`)
    and the page is the rows numbered skip+1 .. skip+limit, so no task holds more
    than its range. Both ways give the same rows with the same values."""
    if skip < 0:
        raise ValueError("skip must be >= 0")
    if limit is not None and not 1 <= limit <= 1000:
        raise ValueError("limit must be within 1..1000")
    if skip and (limit is None or skip + limit > deep_page):
        from stockline.plans.ordered import running_totals
        numbered = running_totals(df.withColumn("_all", F.lit(0)), ["_all"], list(order), {"_rn": None})
        keep = F.col("_rn") > F.lit(skip)
        if limit is not None:
            keep = keep & (F.col("_rn") <= F.lit(skip + limit))
        return numbered.where(keep).orderBy("_rn").drop("_all", "_rn")
    out = df.orderBy(*order)
    if limit is not None:
        out = out.offset(skip).limit(limit) if skip else out.limit(limit)
    return out


# ---------------------------------------------------------------- B1-B4

def by_keys(table: DataFrame, keys: DataFrame, by: str, allowed: tuple) -> DataFrame:
    """Rows of ``table`` whose ``by`` column is among ``keys[by]`` (semi join)."""
    if by not in allowed:
        raise ValueError(f"lookup column must be one of {allowed}")
    k = keys.select(F.col(by).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return table.join(k, table[by] == k["_k"], "left_semi")


def by_value(table: DataFrame, by: str, value) -> DataFrame:
    return table.where(F.col(by) == F.lit(value))


def product_by_key(products: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """B1: products by id / sku / barcode."""
    return by_keys(products, keys, by, PRODUCT_KEYS)


def sale_by_key(sales: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """B2: sales by id / sale number."""
    return by_keys(sales, keys, by, SALE_KEYS)


def category_by_key(categories: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Categories by id / name."""
    return by_keys(categories, keys, by, CATEGORY_KEYS)


def supplier_by_key(suppliers: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Suppliers by id / name / email."""
    return by_keys(suppliers, keys, by, SUPPLIER_KEYS)


# ---------------------------------------------------------------- B5-B12

def product_list(products: DataFrame, category_id: int | None = None, supplier_id: int | None = None,
                 active_only: bool = True, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Optional filters, ANDed; a 0 id means no filter (truthiness)."""
    p = products
    if active_only:
        p = p.where(F.col("is_active") == F.lit(True))
    if category_id:
        p = p.where(F.col("category_id") == F.lit(category_id))
    if supplier_id:
        p = p.where(F.col("supplier_id") == F.lit(supplier_id))
    return page(p, ["id"], skip, limit)


def _search(df: DataFrame, term: str, columns: tuple) -> DataFrame:
    # NULL in one column must not hide a match in another: each test is
    # coalesced to false before the OR.
    cond = reduce(lambda a, b: a | b, [F.coalesce(contains_ci(c, term), F.lit(False)) for c in columns])
    return df.where(cond)


PRODUCT_SEARCH_COLUMNS = ("name", "sku", "barcode", "brand", "description")
SUPPLIER_SEARCH_COLUMNS = ("name", "contact_person", "email", "phone")


def product_search(products: DataFrame, term: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Case-insensitive substring over name, sku, barcode, brand,
    description; inactive products included; ``%``/``_`` are wildcards."""
    return page(_search(products, term, PRODUCT_SEARCH_COLUMNS), ["id"], skip, limit)


def supplier_search(suppliers: DataFrame, term: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Same over name, contact person, email, phone."""
    return page(_search(suppliers, term, SUPPLIER_SEARCH_COLUMNS), ["id"], skip, limit)


def supplier_list(suppliers: DataFrame, active_only: bool = False, skip: int = 0,
                  limit: int | None = None) -> DataFrame:
    """Suppliers, active ones only on request."""
    s = suppliers.where(F.col("is_active") == F.lit(True)) if active_only else suppliers
    return page(s, ["id"], skip, limit)


def category_list(categories: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """All categories."""
    return page(categories, ["id"], skip, limit)


def low_stock(products: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Active and stock <= its minimum (column to column)."""
    p = products.where((F.col("is_active") == F.lit(True))
                       & (F.col("current_stock") <= F.col("min_stock_level")))
    return page(p, ["id"], skip, limit)


def out_of_stock(products: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Active and stock = 0."""
    p = products.where((F.col("is_active") == F.lit(True)) & (F.col("current_stock") == 0))
    return page(p, ["id"], skip, limit)


def slow_moving(products: DataFrame, threshold: int | None = None) -> DataFrame:
    """Active with stock > 0. Kept faithful: the reference accepts a
    threshold and never uses it, and does not look at sales."""
    return products.where((F.col("is_active") == F.lit(True)) & (F.col("current_stock") > 0))


# ---------------------------------------------------------------- B13, B14, C8

def with_user_name(sales: DataFrame, users: DataFrame) -> DataFrame:
    """C8 + H10: ``user_name = full_name or username`` by a left join."""
    u = users.select(F.col("id").alias("_uid"),
                     display_name("full_name", "username").alias("user_name"))
    return sales.join(u, sales.user_id == u._uid, "left").drop("_uid")


def sale_list(sales: DataFrame, users: DataFrame | None = None, status: str | None = None,
              payment_status: str | None = None, start: _dt.date | _dt.datetime | None = None,
              end: _dt.date | _dt.datetime | None = None, skip: int = 0,
              limit: int | None = None) -> DataFrame:
    """B13 + F2: filters on status, payment status and the raw timestamp;
    newest first (NULL dates first, as PostgreSQL ``DESC``). The end bound is
    compared with the raw timestamp, so a date end keeps only sales at its
    midnight on the last day (faithful; :func:`sales_in_range` is inclusive)."""
    s = sales
    if status:
        s = s.where(F.col("status") == F.lit(status))
    if payment_status:
        s = s.where(F.col("payment_status") == F.lit(payment_status))
    if start:
        s = s.where(F.col("sale_date") >= ts_lit(start))
    if end:
        s = s.where(F.col("sale_date") <= ts_lit(end))
    if users is not None:
        s = with_user_name(s, users)
    return page(s, [F.desc_nulls_first("sale_date"), F.desc("id")], skip, limit)


def sales_in_range(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """B14 + F3: all statuses, calendar dates within [start, end], ascending."""
    d = day_of("sale_date")
    s = sales.where((d >= date_lit(start)) & (d <= date_lit(end)))
    return s.orderBy(F.asc_nulls_last("sale_date"), "id")


# ---------------------------------------------------------------- B19

def product_table(products: DataFrame) -> DataFrame:
    """The products page table (sku, name, stock, reorder badge, prices,
    Active / Inactive label)."""
    return products.select(
        "id", "sku", "name", "current_stock",
        reorder_flag("current_stock", "min_stock_level").alias("reorder"),
        to_double("cost_price").alias("cost_price"),
        to_double("selling_price").alias("selling_price"),
        active_label("is_active").alias("status_label"))


def sale_table(sales: DataFrame, sale_items: DataFrame) -> DataFrame:
    """The sales page table with the real line count (C10) and the
    H11 / H12 fallbacks."""
    from stockline.operators.sales import line_counts
    counts = line_counts(sale_items)
    j = sales.join(counts, sales.id == counts.sale_id, "left")
    return j.select(
        "id", "sale_number",
        F.coalesce("sale_date", "created_at").alias("date"),
        customer_label("customer_name").alias("customer"),
        F.coalesce(F.col("items_count"), F.lit(0)).cast("bigint").alias("items_count"),
        to_double("grand_total").alias("grand_total"),
        "status")
