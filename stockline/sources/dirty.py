"""Damaged copies of the shop's tables, so that every data-quality rule has rows to find.

The damage is a fixed rule per column, seeded by the row's id: (column, condition, value), all three plain SQL that Spark
and other engines read alike. Rows are only changed, never added or dropped; several rules of a column apply in order, the
first that holds wins. Keys that point nowhere, repeated unique values, missing values, values out of range and texts
that are too long all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.sources.tables import Shop


def _text(n: int) -> str:
    return f"repeat('x', {n})"


def _spread(step: int, *rules: tuple[str, str]) -> list[tuple[str, str, str]]:
    """Rule number k damages the rows whose id leaves k when divided by ``step``."""
    return [(column, f"id % {step} = {k}", value) for k, (column, value) in enumerate(rules, 1)]


DAMAGE: dict[str, list[tuple[str, str, str]]] = {
    "products": _spread(
        97, ("selling_price", "-1.25"), ("cost_price", "-0.5"), ("current_stock", "-3"), ("cost_price", "selling_price + 1"),
        ("max_stock_level", "min_stock_level"), ("sku", "''"), ("sku", _text(51)), ("name", _text(201)), ("min_stock_level", "-1"),
        ("max_stock_level", "0"), ("weight", "-0.5"), ("tax_rate", "100.5"), ("unit_of_measure", _text(21)), ("brand", _text(101)),
        ("model", _text(101)), ("dimensions", _text(51)), ("barcode", _text(101)), ("sku", "NULL"), ("name", "NULL"), ("cost_price", "NULL"),
        ("selling_price", "NULL"), ("current_stock", "NULL"), ("min_stock_level", "NULL"), ("max_stock_level", "NULL"),
        ("unit_of_measure", "NULL"), ("sku", "'SKU-twice'"), ("barcode", "'890twice'"), ("category_id", "99"), ("supplier_id", "-5")),
    "sales": _spread(
        997, ("payment_method", "'barter'"), ("payment_status", "'late'"), ("status", "'lost'"), ("customer_name", _text(101)),
        ("customer_email", _text(101)), ("customer_phone", _text(21)), ("payment_reference", _text(101)), ("shipping_city", _text(51)),
        ("shipping_state", _text(51)), ("shipping_country", _text(51)), ("shipping_pincode", _text(11)), ("sale_number", "NULL"),
        ("total_amount", "NULL"), ("tax_amount", "NULL"), ("discount_amount", "NULL"), ("grand_total", "NULL"), ("payment_method", "NULL"),
        ("payment_status", "NULL"), ("status", "NULL"), ("sale_number", "'SAL-twice'"), ("user_id", "77")),
    "sale_items": _spread(
        499, ("quantity", "0"), ("unit_price", "-1.5"), ("tax_rate", "-0.5"), ("discount_percent", "100.25"), ("sale_id", "NULL"),
        ("product_id", "NULL"), ("quantity", "NULL"), ("unit_price", "NULL"), ("tax_rate", "NULL"), ("tax_amount", "NULL"),
        ("discount_percent", "NULL"), ("discount_amount", "NULL"), ("subtotal", "NULL"), ("total", "NULL"), ("product_name", "NULL"),
        ("product_sku", "NULL"), ("sale_id", "-9"), ("product_id", "-9")),
    "suppliers": _spread(
        17, ("name", "''"), ("rating", "6"), ("contact_person", _text(101)), ("phone", _text(21)), ("city", _text(51)), ("state", _text(51)),
        ("country", _text(51)), ("postal_code", _text(21)), ("tax_id", _text(51)), ("website", _text(101)), ("payment_terms", _text(101)),
        ("email", "'no at sign'"), ("name", "'Twice Ltd'")),
    "categories": [("name", "id = 2", "'UNUSED'")],
    "users": [("email", "id = 2", "'user1@shop.example'"), ("username", "id = 3", "'user4'")],
}


def damaged(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the damage of ``table``; values take the columns' types."""
    columns = {}
    for column, when, value in DAMAGE[table]:
        held = columns.get(column, F)
        columns[column] = held.when(F.expr(when), F.expr(value).cast(df.schema[column].dataType))
    return df.withColumns({c: case.otherwise(F.col(c)) for c, case in columns.items()})


def dirty_shop(shop: Shop) -> Shop:
    return Shop({name: (lambda n=name: damaged(shop.table(n), n)) for name in DAMAGE})
