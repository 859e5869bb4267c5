import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stockline.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="stockline-tests")
    yield s
    s.stop()


D = Decimal
T0 = dt.datetime(2001, 8, 1, 0, 0, 0)


def products_df(spark, rows):
    """rows: dicts with at least id, sku, name, cost_price, selling_price, current_stock."""
    from stockline import schema as S
    base = {"min_stock_level": 10, "max_stock_level": 100, "unit_of_measure": "pcs", "is_active": True,
            "is_taxable": True, "tax_rate": 18.0, "description": None, "category_id": None, "supplier_id": None,
            "margin": None, "brand": None, "model": None, "weight": None, "dimensions": None, "barcode": None,
            "created_at": None, "updated_at": None, "last_restocked": None}
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in S.PRODUCTS.fields) for r in full], S.PRODUCTS)


def sales_df(spark, rows):
    from stockline import schema as S
    base = {f.name: None for f in S.SALES.fields}
    base.update({"total_amount": D("0"), "tax_amount": D("0"), "discount_amount": D("0"),
                 "grand_total": D("0"), "payment_method": "cash", "payment_status": "pending",
                 "status": "completed"})
    full = [{**base, **r} for r in rows]
    for r in full:
        if r["sale_number"] is None:
            r["sale_number"] = f"SAL-X-{r['id']}"
    return spark.createDataFrame([tuple(r[f.name] for f in S.SALES.fields) for r in full], S.SALES)


def items_df(spark, rows):
    from stockline import schema as S
    base = {f.name: None for f in S.SALE_ITEMS.fields}
    base.update({"unit_price": D("1.00"), "tax_rate": 0.0, "tax_amount": D("0"), "discount_percent": 0.0,
                 "discount_amount": D("0"), "subtotal": D("0"), "total": D("0"), "product_name": "p",
                 "product_sku": "s"})
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in S.SALE_ITEMS.fields) for r in full], S.SALE_ITEMS)


def dims(spark):
    from stockline import schema as S
    cats = spark.createDataFrame([(1, "Tools", None, None, None), (2, "Empty", None, None, None)], S.CATEGORIES)
    sups = spark.createDataFrame([(1, "Acme", "Ann", "a@x.com", "1", None, None, None, "India", None, None,
                                   None, True, None, 5, None, None, None)], S.SUPPLIERS)
    return cats, sups
