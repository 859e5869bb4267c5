"""I5-I7 written month by month: only touched months are rewritten, and the table equals the full snapshot."""
import datetime as dt
import os

import pytest
from conftest import items_df, products_df, sales_df
from decimal import Decimal as D

from stockline.functions.exprs import day_of, month_key
from stockline.operators import posting as po
from stockline.sources import sinks


@pytest.fixture
def stored(spark, tmp_path):
    sales = sales_df(spark, [{"id": i, "status": "draft" if i == 9 else "completed", "payment_status": "paid",
                              "sale_date": None if i == 8 else dt.datetime(2001, 1 + (i % 4) if i < 9 else 9, 3)} for i in range(1, 10)])
    path = f"{tmp_path}/sales"
    sales.withColumn("sale_month", month_key(day_of("sale_date"))).write.partitionBy("sale_month").parquet(path)
    schema = sales.withColumn("sale_month", month_key(day_of("sale_date"))).schema
    return spark.read.schema(schema).parquet(path), path


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def ids(spark, *which):
    return spark.createDataFrame([(i,) for i in which], "request_id long")


def test_cancelling_one_sale_writes_one_month(spark, stored):
    sales, path = stored
    p = products_df(spark, [{"id": 1, "sku": "s", "name": "n", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 5}])
    new_sales, _, result = po.cancel_sales(sales, items_df(spark, [{"sale_id": 2, "product_id": 1, "quantity": 2}]), p, ids(spark, 2))
    want, before = rows(new_sales), files(path)
    changed = result.where("accepted").selectExpr("request_id AS id")
    assert sinks.publish_months(new_sales, changed, path) == ["2001-03"]
    after = files(path)
    assert {f for f in before if f not in after} == {f for f in before if "sale_month=2001-03" in f}
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert rows(spark.read.schema(sales.schema).parquet(path)) == want


def test_patch_delete_and_undated_sales(spark, stored):
    sales, path = stored
    new_sales, _, result = po.delete_drafts(sales, items_df(spark, []), ids(spark, 9, 1))
    want = rows(new_sales)
    assert sinks.publish_months(new_sales, result.where("accepted").selectExpr("request_id AS id"), path) == ["2001-09"]
    assert not os.path.exists(f"{path}/sale_month=2001-09") and rows(spark.read.schema(sales.schema).parquet(path)) == want
    sales = spark.read.schema(sales.schema).parquet(path)
    p = products_df(spark, [])
    undated, _, result = po.cancel_sales(sales, items_df(spark, []), p, ids(spark, 8))
    want = rows(undated)
    assert sinks.publish_months(undated, result.where("accepted").selectExpr("request_id AS id"), path) == [None]
    assert rows(spark.read.schema(sales.schema).parquet(path)) == want
    assert sinks.publish_months(undated, ids(spark).selectExpr("request_id AS id"), path) == []
