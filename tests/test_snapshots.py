"""Dimension merges, product patches, sinks and export dispatch."""
import datetime as dt
import tempfile
from decimal import Decimal as D

import pytest
from conftest import dims, products_df

from stockline.operators import snapshots as sn
from stockline.sources import sinks
from stockline.sources.tables import Shop


def test_merge_suppliers(spark):
    cats, sups = dims(spark)
    p = products_df(spark, [{"id": 1, "sku": "s", "name": "n", "cost_price": D("1"), "selling_price": D("2"),
                             "current_stock": 1, "supplier_id": 1}])
    creates = spark.createDataFrame([(1, "Acme", "new@x.com"), (2, "Beta", "a@x.com"), (3, "Gamma", "g@x.com"),
                                     (4, "Gamma", "h@x.com")], "request_id long, name string, email string")
    deletes = spark.createDataFrame([(1,), (5,)], "request_id long")
    out, prods, res = sn.merge_dimension(sups, p, "supplier", creates=creates, deletes=deletes)
    msgs = sorted((r.request_id, r.message) for r in res.collect())
    assert msgs == [(1, sn.MSG_SUPPLIER_NAME_EXISTS), (1, "ok"), (2, sn.MSG_SUPPLIER_EMAIL_EXISTS), (3, "ok"),
                    (4, sn.MSG_SUPPLIER_NAME_EXISTS), (5, sn.MSG_SUPPLIER_NOT_FOUND)]
    rows = {r.name: (r.id, r.country, r.rating) for r in out.collect()}
    assert rows == {"Gamma": (2, "India", 5)}                       # Acme deleted, Gamma got id 2
    assert prods.first().supplier_id is None                        # ON DELETE SET NULL


def test_patch_products_margin(spark):
    p = products_df(spark, [
        {"id": 1, "sku": "a", "name": "n", "cost_price": D("100.00"), "selling_price": D("150.00"),
         "current_stock": 1, "margin": 50.0, "description": "keep"},
        {"id": 2, "sku": "b", "name": "m", "cost_price": D("0.00"), "selling_price": D("5.00"),
         "current_stock": 1, "margin": 7.0, "description": "drop"}])
    patches = spark.createDataFrame([(1, D("200.00"), True, None, False), (2, D("6.00"), True, None, True),
                                     (9, D("1.00"), True, None, False)],
                                    "request_id long, selling_price decimal(10,2), set_selling_price boolean, "
                                    "description string, set_description boolean")
    out, res = sn.patch_products(p, patches)
    got = {r.id: (r.selling_price, r.margin, r.description) for r in out.collect()}
    assert got == {1: (D("200.00"), 100.0, "keep"), 2: (D("6.00"), 7.0, None)}   # cost 0 keeps old margin
    assert {r.request_id: r.accepted for r in res.collect()} == {1: True, 2: True, 9: False}


def test_sinks_and_dispatch(spark):
    base = tempfile.mkdtemp(prefix="stockline-sink-")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    path = sinks.write_csv(df, f"{base}/csv")
    assert spark.read.option("header", True).csv(path).collect()[0].v == "a"
    with pytest.raises(ValueError):
        sinks.write_snapshot(df, f"{base}/t", source_paths=[f"{base}/t/"])
    with pytest.raises(ValueError):
        sinks.report_for(Shop({}), "weekly-magic", dt.date(2001, 8, 1))
    with pytest.raises(ValueError):
        sinks.export_report(Shop({}), "sales", base, dt.date(2001, 8, 1), fmt="pdf")
