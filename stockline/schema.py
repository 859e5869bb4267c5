"""Fixed schemas of the six shop tables.

Keys are ``bigint``; money is ``decimal(10,2)``; percentages are ``double``;
timestamps are wall-clock ``timestamp_ntz`` (what the parquet inputs carry).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
KEY = T.LongType()
TS = T.TimestampNTZType()


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CATEGORIES = _s(
    ("id", KEY, False), ("name", T.StringType(), False), ("description", T.StringType(), True),
    ("created_at", TS, True), ("updated_at", TS, True),
)

SUPPLIERS = _s(
    ("id", KEY, False), ("name", T.StringType(), False),
    ("contact_person", T.StringType(), True), ("email", T.StringType(), True),
    ("phone", T.StringType(), True), ("address", T.StringType(), True),
    ("city", T.StringType(), True), ("state", T.StringType(), True),
    ("country", T.StringType(), True), ("postal_code", T.StringType(), True),
    ("tax_id", T.StringType(), True), ("website", T.StringType(), True),
    ("is_active", T.BooleanType(), True), ("payment_terms", T.StringType(), True),
    ("rating", T.IntegerType(), True), ("notes", T.StringType(), True),
    ("created_at", TS, True), ("updated_at", TS, True),
)

PRODUCTS = _s(
    ("id", KEY, False), ("sku", T.StringType(), False), ("name", T.StringType(), False),
    ("description", T.StringType(), True), ("category_id", KEY, True), ("supplier_id", KEY, True),
    ("cost_price", MONEY, False), ("selling_price", MONEY, False), ("margin", T.DoubleType(), True),
    ("current_stock", T.IntegerType(), False), ("min_stock_level", T.IntegerType(), False),
    ("max_stock_level", T.IntegerType(), False), ("unit_of_measure", T.StringType(), False),
    ("brand", T.StringType(), True), ("model", T.StringType(), True),
    ("weight", T.DoubleType(), True), ("dimensions", T.StringType(), True),
    ("barcode", T.StringType(), True), ("is_active", T.BooleanType(), True),
    ("is_taxable", T.BooleanType(), True), ("tax_rate", T.DoubleType(), True),
    ("created_at", TS, True), ("updated_at", TS, True), ("last_restocked", TS, True),
)

SALES = _s(
    ("id", KEY, False), ("sale_number", T.StringType(), False),
    ("customer_name", T.StringType(), True), ("customer_email", T.StringType(), True),
    ("customer_phone", T.StringType(), True),
    ("total_amount", MONEY, False), ("tax_amount", MONEY, False),
    ("discount_amount", MONEY, False), ("grand_total", MONEY, False),
    ("payment_method", T.StringType(), False), ("payment_status", T.StringType(), False),
    ("payment_reference", T.StringType(), True), ("status", T.StringType(), False),
    ("shipping_address", T.StringType(), True), ("shipping_city", T.StringType(), True),
    ("shipping_state", T.StringType(), True), ("shipping_country", T.StringType(), True),
    ("shipping_pincode", T.StringType(), True), ("notes", T.StringType(), True),
    ("user_id", KEY, True), ("sale_date", TS, True), ("created_at", TS, True),
    ("updated_at", TS, True),
)

# Ids of sale lines made here: the sale's id times this, and the line's place in its sale.
LINES_PER_SALE = 1_000_000_000

SALE_ITEMS = _s(
    ("id", KEY, True), ("sale_id", KEY, False), ("product_id", KEY, False), ("quantity", T.IntegerType(), False),
    ("unit_price", MONEY, False), ("tax_rate", T.DoubleType(), False),
    ("tax_amount", MONEY, False), ("discount_percent", T.DoubleType(), False),
    ("discount_amount", MONEY, False), ("subtotal", MONEY, False), ("total", MONEY, False),
    ("product_name", T.StringType(), False), ("product_sku", T.StringType(), False),
    ("product_barcode", T.StringType(), True), ("created_at", TS, True),
)

USERS = _s(
    ("id", KEY, False), ("email", T.StringType(), False), ("username", T.StringType(), False),
    ("full_name", T.StringType(), True), ("is_active", T.BooleanType(), True),
    ("is_admin", T.BooleanType(), True),
)

# Request frames of the table-changing operators (section I).
SALE_LINE_REQUEST = _s(
    ("request_id", KEY, False), ("product_id", KEY, False), ("quantity", T.IntegerType(), False),
    ("unit_price", MONEY, False), ("tax_rate", T.DoubleType(), False),
    ("discount_percent", T.DoubleType(), False),
)

RESULT = _s(("request_id", KEY, False), ("accepted", T.BooleanType(), False),
            ("message", T.StringType(), True))

# Fixed values of the domain (must equal the reference's enumerations).
PAYMENT_METHODS = ["cash", "card", "upi", "bank_transfer", "cheque"]
PAYMENT_STATUSES = ["pending", "paid", "partial", "refunded"]
SALE_STATUSES = ["draft", "completed", "cancelled"]
STOCK_STATUS_OUT = "Out of Stock"
STOCK_STATUS_LOW = "Low Stock"
STOCK_STATUS_ADEQUATE = "Adequate"
STOCK_STATUS_OVER = "Over Stock"
NOT_AVAILABLE = "N/A"
WALK_IN = "Walk-in"


def conform(df, schema: T.StructType):
    """Select and cast ``df`` to ``schema`` (missing columns become NULL)."""
    from pyspark.sql import functions as F
    cols = []
    present = set(df.columns)
    for f in schema.fields:
        c = F.col(f.name) if f.name in present else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
