"""Stored parquet tables read back with the fixed schemas give the same reports."""
import datetime as dt
import os
import tempfile

from stockline import schema as S
from stockline.operators import inventory as inv
from stockline.operators import sales as sal
from stockline.sources.tables import SCHEMAS, read_parquet_shop
from stockline.sources.views import driver_shop

SF = "/root/testdata/sf0.001"


def test_parquet_shop_round_trip(spark):
    if not os.path.isdir(SF):
        return
    base = tempfile.mkdtemp(prefix="stockline-shop-")
    views = driver_shop(spark, SF)
    for name, schema in SCHEMAS.items():
        S.conform(views.table(name), schema).write.parquet(f"{base}/{name}")
    shop = read_parquet_shop(spark, base)
    a, b = dt.date(1995, 1, 1), dt.date(2001, 8, 1)
    assert sorted(sal.sales_by_period(shop.sales, shop.sale_items, a, b, "month").collect()) == \
        sorted(sal.sales_by_period(views.sales, views.sale_items, a, b, "month").collect())
    assert inv.product_report_summary(shop.products, shop.categories, shop.suppliers).collect() == \
        inv.product_report_summary(views.products, views.categories, views.suppliers).collect()
