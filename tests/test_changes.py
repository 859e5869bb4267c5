"""Change operators on repeated requests, lone bounds, missing dates and fractional percents."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from stockline.functions.exprs import line_amounts
from stockline.operators import filters, posting, snapshots
from stockline.sources import sinks
from tests.conftest import T0, dims, items_df, products_df, sales_df


def test_patch_of_status_keeps_the_other_fields(spark):
    sales = sales_df(spark, [{"id": 1, "status": "draft", "sale_date": T0}, {"id": 2, "status": "completed", "sale_date": T0}])
    patches = spark.createDataFrame(
        [(1, "completed", "n", "Pune", True, True, True), (2, "draft", "x", "y", True, True, True)],
        "request_id long, status string, notes string, shipping_city string, set_status boolean, set_notes boolean, set_shipping_city boolean")
    out, _ = posting.patch_sales(sales, patches)
    got = {r.id: (r.status, r.notes, r.shipping_city) for r in out.collect()}
    assert got == {1: ("completed", "n", "Pune"), 2: ("completed", None, None)}


def test_two_patches_of_a_key_are_folded(spark):
    sales = sales_df(spark, [{"id": 1, "status": "draft", "sale_date": T0}, {"id": 2, "status": "draft", "sale_date": T0}])
    patches = spark.createDataFrame(
        [(1, 1, "first", True, "Pune", True), (1, 2, "second", True, None, False)],
        "request_id long, seq int, notes string, set_notes boolean, shipping_city string, set_shipping_city boolean")
    out, result = posting.patch_sales(sales, patches)
    got = {r.id: (r.notes, r.shipping_city) for r in out.collect()}
    assert out.count() == 2 and got[1] == ("second", "Pune") and result.count() == 1
    products = products_df(spark, [{"id": 1, "sku": "a", "name": "a", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 1}])
    twice = spark.createDataFrame([(1, 1, "b", True), (1, 2, "c", True)], "request_id long, seq int, name string, set_name boolean")
    patched, _ = snapshots.patch_products(products, twice)
    assert [r.name for r in patched.collect()] == ["c"]


def test_numbers_of_sales_without_a_date(spark):
    new = spark.createDataFrame([(1, T0), (2, None), (3, T0)], "request_id long, sale_date timestamp_ntz")
    old = sales_df(spark, [{"id": 9, "sale_number": "SAL-20010801-004", "sale_date": T0}])
    got = {r.request_id: r.sale_number for r in posting.sale_numbers(new, old).collect()}
    assert got == {1: "SAL-20010801-005", 2: None, 3: "SAL-20010801-006"}
    got = {r.request_id: r.sale_number for r in posting.sale_numbers(new, old, dt.datetime(2001, 8, 2)).collect()}
    assert got[2] == "SAL-20010802-001"


def test_fractional_percents_are_exact(spark):
    lines = spark.range(20_000).select(F.lit("0.03").cast("decimal(10,2)").alias("p"), F.lit(1).alias("q"),
                                       F.lit(12.5).alias("d"), F.lit(7.25).alias("t"))
    a = line_amounts("p", "q", "t", "d")
    got = lines.agg(F.sum(a["tax_amount"]).alias("tax"), F.sum(a["total"]).alias("total")).first()
    one = D("0.03") * (1 - D("0.125"))
    assert got.tax == 20_000 * one * D("0.0725") and got.total == 20_000 * one * D("1.0725")


def test_repeated_keys_and_no_changes(spark):
    cats, _ = dims(spark)
    keys = spark.createDataFrame([(1,)] * 5, "id long")
    assert filters.category_by_key(cats, keys).count() == 1
    out, _, result = snapshots.merge_dimension(cats, products_df(spark, [
        {"id": 1, "sku": "a", "name": "a", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 1}]), "category")
    assert out.count() == cats.count() and result.count() == 0


def test_report_with_one_bound(spark):
    class Shop:
        sales = sales_df(spark, [{"id": 1, "sale_date": dt.datetime(1999, 5, 1), "grand_total": D("5.00")}])
        sale_items = items_df(spark, [{"id": 1, "sale_id": 1, "product_id": 1, "quantity": 2, "total": D("5.00")}])

    data, summary = sinks.report_for(Shop, "sales", dt.date(2001, 8, 1), start=dt.date(1998, 1, 1))
    assert data.count() == 1
    _, summary = sinks.report_for(Shop, "sales", dt.date(2001, 8, 1), start=dt.date(1998, 1, 1), group_by="product")
    assert summary.first().top_product == "p"


def test_refused_request_takes_no_name(spark):
    cats, sups = dims(spark)
    p = products_df(spark, [{"id": 1, "sku": "s", "name": "n", "cost_price": D("1"), "selling_price": D("2"),
                             "current_stock": 1}])
    req = spark.createDataFrame(
        [(1, "a", "x", 99), (2, "a", "y", None), (3, "b", "y", None), (4, "b", "z", None), (5, "a", "z", None)],
        "request_id long, sku string, barcode string, category_id long").withColumn("name", F.lit("n")).withColumn(
        "cost_price", F.lit(1.0)).withColumn("selling_price", F.lit(2.0))
    _, result = snapshots.add_products(p, cats, sups, req, T0)
    # 1 has no category and takes nothing; 2 takes (a, y); 3 loses y to it, so 4 may take (b, z); 5 loses a.
    assert {r.request_id: r.message for r in result.collect()} == {
        1: snapshots.MSG_CATEGORY_NOT_FOUND, 2: "ok", 3: snapshots.MSG_BARCODE_EXISTS, 4: "ok", 5: snapshots.MSG_SKU_EXISTS}


def test_deep_page_keeps_large_nullable_integers(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, None), (2, big), (3, None), (4, big + 2)], "id long, v long")
    want = [(2, big), (3, None)]
    assert [tuple(r) for r in filters.page(df, ["id"], 1, 2).collect()] == want
    assert [tuple(r) for r in filters.page(df, ["id"], 1, 2, deep_page=1).collect()] == want
    assert [tuple(r) for r in filters.page(df, ["id"], 1).collect()] == want + [(4, big + 2)]


def test_changed_rows_get_the_stamp(spark):
    now = dt.datetime(2001, 8, 2, 9)
    sales = sales_df(spark, [{"id": k, "status": "draft", "sale_date": T0} for k in (1, 2)])
    items = items_df(spark, [{"sale_id": 1, "product_id": 1, "quantity": 2}])
    products = products_df(spark, [{"id": k, "sku": f"s{k}", "name": "n", "cost_price": D("1"), "selling_price": D("2"),
                                    "current_stock": 5} for k in (1, 2)])
    one = spark.createDataFrame([(1,)], "request_id long")
    note = spark.createDataFrame([(1, "n", True)], "request_id long, notes string, set_notes boolean")
    name = spark.createDataFrame([(1, "b", True)], "request_id long, name string, set_name boolean")
    change = spark.createDataFrame([(1, 1, 3), (2, 2, -9)], "request_id long, product_id long, quantity int")
    line = spark.createDataFrame([(7, 1, 2), (8, 2, 6)], "request_id long, product_id long, quantity int")
    header = spark.createDataFrame([(7, T0), (8, T0)], "request_id long, sale_date timestamp_ntz")
    cancelled, restocked, _ = posting.cancel_sales(sales, items, products, one, now)
    frames = [cancelled, restocked, posting.patch_sales(sales, note, now)[0], snapshots.patch_products(products, name, now)[0],
              snapshots.bulk_stock(products, change, now)[0], snapshots.deactivate_products(products, one, now)[0],
              posting.post_sales(line, header, products, now=now)[0]]
    for frame in frames:
        assert {r.id: r.updated_at for r in frame.collect()} == {1: now, 2: None}
    unstamped = posting.patch_sales(sales, note)[0]
    assert {r.updated_at for r in unstamped.collect()} == {None}
