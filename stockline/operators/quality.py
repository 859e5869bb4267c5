"""Data-quality rules J1-J8: table -> violation rows ``(table_name, record_key, rule)``.

Row rules of one table are checked in a single pass: every rule is a
predicate, the failed rule names of a row are collected into an array and
exploded, so one scan serves all rules. A rule with a NULL operand does not
fire (NULLs are J8's business). Uniqueness (J3) is a grouped count with a
partial aggregate; foreign keys (J4) are anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.session import partitions_for


# Fixed rule lists: (rule name, predicate that must hold). Limits are the
# reference's field limits.
PRODUCT_CHECKS = [
    ("selling_price_non_negative", "selling_price >= 0"),
    ("cost_price_non_negative", "cost_price >= 0"),
    ("stock_non_negative", "current_stock >= 0"),
    ("price_not_below_cost", "selling_price >= cost_price"),
    ("max_above_min", "max_stock_level > min_stock_level"),
]
PRODUCT_FIELDS = [
    ("sku_length", "length(sku) BETWEEN 1 AND 50"),
    ("name_length", "length(name) BETWEEN 1 AND 200"),
    ("min_stock_non_negative", "min_stock_level >= 0"),
    ("max_stock_at_least_one", "max_stock_level >= 1"),
    ("weight_non_negative", "weight >= 0"),
    ("tax_rate_range", "tax_rate BETWEEN 0 AND 100"),
    ("unit_length", "length(unit_of_measure) <= 20"),
    ("brand_length", "length(brand) <= 100"),
    ("model_length", "length(model) <= 100"),
    ("dimensions_length", "length(dimensions) <= 50"),
    ("barcode_length", "length(barcode) <= 100"),
]
SALE_LINE_CHECKS = [
    ("quantity_positive", "quantity > 0"),
    ("unit_price_non_negative", "unit_price >= 0"),
    ("tax_rate_range", "tax_rate BETWEEN 0 AND 100"),
    ("discount_range", "discount_percent BETWEEN 0 AND 100"),
]
SALE_CHECKS = [
    ("payment_method_known", "payment_method IN ('cash', 'card', 'upi', 'bank_transfer', 'cheque')"),
    ("payment_status_known", "payment_status IN ('pending', 'paid', 'partial', 'refunded')"),
    ("status_known", "status IN ('draft', 'completed', 'cancelled')"),
    ("customer_name_length", "length(customer_name) <= 100"),
    ("customer_email_length", "length(customer_email) <= 100"),
    ("customer_phone_length", "length(customer_phone) <= 20"),
    ("payment_reference_length", "length(payment_reference) <= 100"),
    ("shipping_city_length", "length(shipping_city) <= 50"),
    ("shipping_state_length", "length(shipping_state) <= 50"),
    ("shipping_country_length", "length(shipping_country) <= 50"),
    ("shipping_pincode_length", "length(shipping_pincode) <= 10"),
]
SUPPLIER_CHECKS = [
    ("name_length", "length(name) BETWEEN 1 AND 100"),
    ("rating_range", "rating BETWEEN 1 AND 5"),
    ("contact_length", "length(contact_person) <= 100"),
    ("phone_length", "length(phone) <= 20"),
    ("city_length", "length(city) <= 50"),
    ("state_length", "length(state) <= 50"),
    ("country_length", "length(country) <= 50"),
    ("postal_code_length", "length(postal_code) <= 20"),
    ("tax_id_length", "length(tax_id) <= 50"),
    ("website_length", "length(website) <= 100"),
    ("payment_terms_length", "length(payment_terms) <= 100"),
]
# A simple e-mail shape (weaker than a full address validator).
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NOT_NULL = {
    "products": ["sku", "name", "cost_price", "selling_price", "current_stock", "min_stock_level",
                 "max_stock_level", "unit_of_measure"],
    "sales": ["sale_number", "total_amount", "tax_amount", "discount_amount", "grand_total",
              "payment_method", "payment_status", "status"],
    "sale_items": ["sale_id", "product_id", "quantity", "unit_price", "tax_rate", "tax_amount",
                   "discount_percent", "discount_amount", "subtotal", "total", "product_name",
                   "product_sku"],
}
UNIQUE = [("categories", "name"), ("suppliers", "name"), ("products", "sku"), ("products", "barcode"),
          ("sales", "sale_number"), ("users", "email"), ("users", "username")]

VIOLATION_COLS = ["table_name", "record_key", "rule"]


def line_key() -> Column:
    """A sale line's id; lines without one are named by sale and product."""
    return F.coalesce(F.col("id").cast("string"), F.concat_ws(":", F.col("sale_id").cast("string"), F.col("product_id").cast("string")))


def row_rules(df: DataFrame, table: str, rules: list[tuple[str, str | Column]],
              key: Column | None = None) -> DataFrame:
    """One pass: the names of the failed rules of each row, exploded."""
    key = F.col("id").cast("string") if key is None else key
    failed = [F.when(~F.coalesce(F.expr(p) if isinstance(p, str) else p, F.lit(True)), F.lit(name))
              for name, p in rules]
    return (df.select(key.alias("record_key"), F.array_compact(F.array(*failed)).alias("_f"))
            .where(F.size("_f") > 0)
            .select(F.lit(table).alias("table_name"), "record_key", F.explode("_f").alias("rule")))


def dq_product_checks(products: DataFrame) -> DataFrame:
    """Price, cost and stock not negative; price >= cost; max > min."""
    return row_rules(products, "products", PRODUCT_CHECKS)


def dq_product_fields(products: DataFrame) -> DataFrame:
    """Field lengths and ranges of the product form."""
    return row_rules(products, "products", PRODUCT_FIELDS)


def dq_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """Values that repeat in a unique column (NULLs may repeat)."""
    parts = []
    for table, col in UNIQUE:
        if table not in tables:
            continue
        d = (tables[table].where(F.col(col).isNotNull()).groupBy(col).count()
             .where(F.col("count") > 1))
        parts.append(d.select(F.lit(table).alias("table_name"), F.col(col).cast("string").alias("record_key"),
                              F.lit(f"unique_{col}").alias("rule")))
    return _union(parts)


def dq_foreign_keys(products: DataFrame, categories: DataFrame, suppliers: DataFrame, sales: DataFrame,
                    sale_items: DataFrame, users: DataFrame) -> DataFrame:
    """Product -> category / supplier, line -> sale / product, sale -> user."""
    def missing(child, fk, parent, table, rule, key):
        c = child.where(F.col(fk).isNotNull())
        bad = c.join(parent.select(F.col("id").alias(fk)), fk, "left_anti")
        return bad.select(F.lit(table).alias("table_name"), key.alias("record_key"), F.lit(rule).alias("rule"))
    pid = F.col("id").cast("string")
    return _union([
        missing(products, "category_id", categories, "products", "fk_category", pid),
        missing(products, "supplier_id", suppliers, "products", "fk_supplier", pid),
        missing(sale_items.withColumn("_k", line_key()), "sale_id", sales, "sale_items", "fk_sale", F.col("_k")),
        missing(sale_items.withColumn("_k", line_key()), "product_id", products, "sale_items", "fk_product",
                F.col("_k")),
        missing(sales, "user_id", users, "sales", "fk_user", pid),
    ])


def dq_sale_lines(sales: DataFrame, sale_items: DataFrame) -> DataFrame:
    """Line ranges, and every sale has at least one line."""
    rows = row_rules(sale_items, "sale_items", SALE_LINE_CHECKS, line_key())
    # Ids shuffle to so few bytes that partitions sized by bytes hold millions of them; these are sized by rows.
    parts = partitions_for(sales.count() + sale_items.count())
    with_lines = sale_items.select(F.col("sale_id").alias("id")).repartition(parts, "id").distinct()
    empty = (sales.select("id").repartition(parts, "id").join(with_lines, "id", "left_anti")
             .select(F.lit("sales").alias("table_name"), F.col("id").cast("string").alias("record_key"),
                     F.lit("has_lines").alias("rule")))
    return rows.unionByName(empty)


def dq_sales(sales: DataFrame) -> DataFrame:
    """Enumerations and length limits of the sale form."""
    return row_rules(sales, "sales", SALE_CHECKS)


def dq_suppliers(suppliers: DataFrame) -> DataFrame:
    """Supplier form limits and the e-mail shape."""
    rules = SUPPLIER_CHECKS + [("email_shape", F.col("email").rlike(EMAIL_PATTERN))]
    return row_rules(suppliers, "suppliers", rules)


def dq_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """NOT NULL columns."""
    parts = []
    for table, cols in NOT_NULL.items():
        if table not in tables:
            continue
        key = line_key() if table == "sale_items" else None
        parts.append(row_rules(tables[table], table, [(f"not_null_{c}", F.col(c).isNotNull()) for c in cols], key))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*VIOLATION_COLS)


def all_tables(shop) -> dict[str, DataFrame]:
    return {n: shop.table(n) for n in ("categories", "suppliers", "products", "sales", "sale_items", "users")}

