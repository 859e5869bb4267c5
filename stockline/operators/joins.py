"""Joins and nesting: C2, C4-C7, C9, C11, C12 (C1, C3, C8, C10 live next to
their reports).

Nested results are ``struct`` / ``array<struct>`` columns built with
built-in functions. A sale of any number of lines is a flat pair
(:func:`sale_and_lines`); arrays are whole or in bounded parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions.exprs import contains_ci, display_name, or_na, ratio, to_double
from stockline.operators.filters import page
from stockline.operators.inventory import with_names
from stockline.operators.sales import completed_between, rolling_window
from stockline.plans.ordered import running_totals

CATEGORY_FIELDS_FULL = ("id", "name", "description", "created_at", "updated_at")
SUPPLIER_FIELDS_FULL = ("id", "name", "contact_person", "email", "phone", "address", "city", "state",
                        "country", "postal_code", "tax_id", "website", "is_active", "payment_terms",
                        "rating", "notes", "created_at", "updated_at")
CATEGORY_FIELDS_SHORT = ("id", "name", "description")
SUPPLIER_FIELDS_SHORT = ("id", "name", "contact_person", "email")


def product_enriched(products: DataFrame, categories: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Every product with ``category_name`` / ``supplier_name`` (NULL when
    the product has none)."""
    return (with_names(products, categories, suppliers, na=False)
            .withColumnRenamed("category", "category_name")
            .withColumnRenamed("supplier", "supplier_name"))


def _by_dimension_name(products: DataFrame, dim: DataFrame, fk: str, term: str) -> DataFrame:
    d = dim.where(F.coalesce(contains_ci("name", term), F.lit(False))).select(F.col("id").alias("_did"))
    p = products.where(F.col("is_active") == F.lit(True))
    return p.join(d, p[fk] == d._did, "left_semi")


def products_by_category(products: DataFrame, categories: DataFrame, name: str,
                         skip: int = 0, limit: int | None = None) -> DataFrame:
    """C4: active products whose category name contains ``name`` (ILIKE).
    Category names are unique, so a semi join equals the inner join."""
    return page(_by_dimension_name(products, categories, "category_id", name), ["id"], skip, limit)


def products_by_supplier(products: DataFrame, suppliers: DataFrame, name: str,
                         skip: int = 0, limit: int | None = None) -> DataFrame:
    """Same by supplier name."""
    return page(_by_dimension_name(products, suppliers, "supplier_id", name), ["id"], skip, limit)


def _nest(products, categories, suppliers, cat_fields, sup_fields) -> DataFrame:
    cat = categories.select(F.col("id").alias("_cid"),
                            F.struct(*[F.col(c) for c in cat_fields]).alias("category"))
    sup = suppliers.select(F.col("id").alias("_sid"),
                           F.struct(*[F.col(c) for c in sup_fields]).alias("supplier"))
    return (products.join(cat, products.category_id == cat._cid, "left")
            .join(sup, products.supplier_id == sup._sid, "left")
            .drop("_cid", "_sid"))


def product_with_details(products: DataFrame, categories: DataFrame, suppliers: DataFrame,
                         category_id: int | None = None, supplier_id: int | None = None,
                         active_only: bool = True, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Every product column plus a 5-field ``category`` struct and an
    18-field ``supplier`` struct (NULL when unmatched) and their names."""
    p = products
    if active_only:
        p = p.where(F.col("is_active") == F.lit(True))
    if category_id:
        p = p.where(F.col("category_id") == F.lit(category_id))
    if supplier_id:
        p = p.where(F.col("supplier_id") == F.lit(supplier_id))
    n = _nest(p, categories, suppliers, CATEGORY_FIELDS_FULL, SUPPLIER_FIELDS_FULL)
    n = n.withColumn("category_name", F.col("category.name")).withColumn(
        "supplier_name", F.col("supplier.name"))
    return page(n, ["id"], skip, limit)


def product_detail(products: DataFrame, categories: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Products with a 3-field category and a 4-field supplier struct."""
    return _nest(products, categories, suppliers, CATEGORY_FIELDS_SHORT, SUPPLIER_FIELDS_SHORT)


ITEM_FIELDS = ("product_id", "quantity", "unit_price", "tax_rate", "tax_amount", "discount_percent",
               "discount_amount", "subtotal", "total", "product_name", "product_sku", "product_barcode")


def numbered_lines(sale_items: DataFrame) -> DataFrame:
    """``sale_items`` with ``line_no``, 1.. within each sale, in the order of :data:`ITEM_FIELDS`. Counted over ranges, so
    the lines of a hot sale are many tasks' work. Lines of no sale are left out."""
    return running_totals(sale_items.where("sale_id is not null"), ["sale_id"], list(ITEM_FIELDS), {"line_no": None})


def sale_and_lines(sales: DataFrame, sale_items: DataFrame, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C9 (+ C8) as a flat pair: (headers with ``line_count``, lines with ``line_no`` from 1). A sale of any size is
    rows of the same shape, and no task holds a sale's lines."""
    counts = sale_items.groupBy("sale_id").agg(F.count(F.lit(1)).alias("line_count"))
    heads = sales.join(counts, sales.id == counts.sale_id, "left").drop("sale_id").withColumn(
        "line_count", F.coalesce("line_count", F.lit(0)))
    return _named(heads, users), numbered_lines(sale_items)


def sale_item_arrays(sales: DataFrame, sale_items: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """C9 (+ C8) nested: one row per sale with all its ``items`` in one sorted array, an empty one when it has none. An
    array is one value of one task; sales without a bound on their lines are :func:`sale_and_lines`' case."""
    items = sale_items.groupBy("sale_id").agg(F.sort_array(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items"))
    return _with_arrays(sales, items, users)


def sale_with_items(sales: DataFrame, sale_items: DataFrame, users: DataFrame | None = None,
                    chunk_lines: int = 10000) -> DataFrame:
    """C9 (+ C8) nested in bounded rows: a sale's lines in order, at most ``chunk_lines`` to an ``items`` array, one row per
    ``part`` 0, 1, ...; one part with an empty array when it has no lines."""
    # Sales of one part need no numbers; only lines of larger ones are counted, over ranges.
    large = sale_items.groupBy("sale_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_lines).select("sale_id")
    zero = F.lit(0).cast("bigint")
    many = numbered_lines(sale_items.join(large, "sale_id", "left_semi")).withColumn(
        "part", F.floor((F.col("line_no") - 1) / F.lit(chunk_lines))).drop("line_no")
    lines = sale_items.join(large, "sale_id", "left_anti").withColumn("part", zero).unionByName(many)
    items = lines.groupBy("sale_id", "part").agg(F.sort_array(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items"))
    return _with_arrays(sales, items, users).withColumn("part", F.coalesce("part", zero))


def _with_arrays(sales: DataFrame, items: DataFrame, users: DataFrame | None) -> DataFrame:
    # The arrays hold every line: their size grows with the data and has no
    # bound, so this side is never broadcast (the static estimate comes from
    # compressed file sizes and can be far too small).
    j = sales.join(items.hint("merge"), sales.id == items.sale_id, "left").drop("sale_id")
    return _named(j.withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType))), users)


def _named(sales: DataFrame, users: DataFrame | None) -> DataFrame:
    if users is None:
        return sales
    u = users.select(F.col("id").alias("_uid"), display_name("full_name", "username").alias("user_name"))
    return sales.join(u, sales.user_id == u._uid, "left").drop("_uid")


def fk_violations(sale_lines: DataFrame | None = None, products: DataFrame | None = None,
                  new_products: DataFrame | None = None, categories: DataFrame | None = None,
                  suppliers: DataFrame | None = None) -> DataFrame:
    """C11: existence checks as anti joins, one violation row each:
    ``(kind, request_id, missing_key)``. Sale lines need their product; new
    products need their category and supplier (when given)."""
    parts = []
    if sale_lines is not None and products is not None:
        bad = sale_lines.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti")
        parts.append(bad.select(F.lit("sale_line_product").alias("kind"), F.col("request_id"),
                                F.col("product_id").alias("missing_key")))
    if new_products is not None and categories is not None:
        np_ = new_products.where(F.col("category_id").isNotNull())
        bad = np_.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti")
        parts.append(bad.select(F.lit("product_category").alias("kind"), F.col("request_id"),
                                F.col("category_id").alias("missing_key")))
    if new_products is not None and suppliers is not None:
        np_ = new_products.where(F.col("supplier_id").isNotNull())
        bad = np_.join(suppliers.select(F.col("id").alias("supplier_id")), "supplier_id", "left_anti")
        parts.append(bad.select(F.lit("product_supplier").alias("kind"), F.col("request_id"),
                                F.col("supplier_id").alias("missing_key")))
    if not parts:
        raise ValueError("nothing to check")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_performance(sales: DataFrame, sale_items: DataFrame, products: DataFrame,
                         categories: DataFrame, as_of, days: int = 90) -> DataFrame:
    """C12 (declared but a stub in the reference; built here as labelled):
    completed sales of the window per the product's current category
    ('N/A' without one): quantity, revenue, mean unit price, lines.
    Lines are aggregated per product first (partial aggregate), so only one
    row per product meets the product / category joins."""
    start, end = rolling_window(as_of, days)
    s = completed_between(sales, start, end).select(F.col("id").alias("sale_id"))
    per_product = (sale_items.join(s, "sale_id", "left_semi").groupBy("product_id")
                   .agg(F.sum("quantity").alias("q"), F.sum("total").alias("rev"),
                        F.sum("unit_price").alias("ps"), F.count(F.lit(1)).alias("n")))
    p = products.select(F.col("id").alias("product_id"), "category_id")
    c = categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    j = (per_product.join(p, "product_id", "left")
         .join(c, F.col("category_id") == c._cid, "left")
         .withColumn("category", or_na("_cname", "_cid")))
    g = j.groupBy("category").agg(F.sum("q").alias("q"), F.sum("rev").alias("rev"),
                                  F.sum("ps").alias("ps"), F.sum("n").alias("n"))
    return (g.select("category", F.col("q").cast("bigint").alias("total_quantity"),
                     to_double("rev").alias("total_revenue"), ratio("ps", "n").alias("avg_price"),
                     F.col("n").cast("bigint").alias("line_count"), F.col("rev").alias("_rev"))
             .orderBy(F.desc("_rev"), "category").drop("_rev"))
