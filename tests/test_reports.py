"""Edge tables for the report family (FIXTURES.md section 4)."""
import datetime as dt
from decimal import Decimal as D

from conftest import dims, items_df, products_df, sales_df

from stockline.operators import filters as fl
from stockline.operators import inventory as inv
from stockline.operators import sales as sal


def _shop(spark):
    sales = sales_df(spark, [
        {"id": 1, "sale_date": dt.datetime(2001, 7, 31, 0, 0), "grand_total": D("10.00"), "customer_name": None},
        {"id": 2, "sale_date": dt.datetime(2001, 7, 31, 10, 0), "grand_total": D("20.01"), "customer_name": None},
        {"id": 3, "sale_date": dt.datetime(2001, 7, 29, 9, 0), "grand_total": D("5.00"), "customer_name": "Bo"},
        {"id": 4, "sale_date": dt.datetime(2001, 7, 30, 9, 0), "grand_total": D("7.00"), "status": "draft"},
    ])
    items = items_df(spark, [
        {"sale_id": 1, "product_id": 1, "quantity": 2, "total": D("4.00"), "product_name": "A", "product_sku": "a1"},
        {"sale_id": 1, "product_id": 2, "quantity": 1, "total": D("6.00"), "product_name": "A", "product_sku": "a2"},
        {"sale_id": 2, "product_id": 2, "quantity": 5, "total": D("20.01"), "product_name": "A", "product_sku": "a2"},
    ])
    return sales, items


def test_period_report_and_rounding(spark):
    sales, items = _shop(spark)
    rows = sal.sales_by_period(sales, items, dt.date(2001, 7, 1), dt.date(2001, 7, 31), "day").collect()
    by = {str(r.period): r for r in rows}
    assert set(by) == {"2001-07-29", "2001-07-31"}
    r = by["2001-07-31"]
    # mean of 10.00 and 20.01 is 15.005 -> half up 15.01 (not the float 15.00)
    assert (r.sales_count, r.total_revenue, r.avg_order_value, r.total_items) == (2, 30.01, 15.01, 3)
    assert by["2001-07-29"].total_items == 0            # a sale without lines counts 0 lines
    s = sal.sales_period_summary(sales, items, dt.date(2001, 7, 1), dt.date(2001, 7, 31)).first()
    assert (s.total_sales, s.total_customers, s.total_products_sold, s.max_order) == (3, 1, 3, 20.01)


def test_empty_period_keeps_schema(spark):
    sales, items = _shop(spark)
    df = sal.sales_by_period(sales, items, dt.date(1990, 1, 1), dt.date(1990, 1, 2), "week")
    assert df.count() == 0 and df.columns == ["period", "sales_count", "total_revenue", "avg_order_value",
                                              "total_items"]
    s = sal.sales_period_summary(sales, items, dt.date(1990, 1, 1), dt.date(1990, 1, 2)).first()
    assert (s.total_sales, s.total_revenue, s.avg_order_value, s.max_order) == (0, 0.0, 0.0, None)


def test_end_date_midnight_vs_inclusive(spark):
    sales, _ = _shop(spark)
    strict = fl.sale_list(sales, end=dt.date(2001, 7, 31), start=dt.date(2001, 7, 31))
    assert [r.id for r in strict.collect()] == [1]                     # B13: 10:00 drops out
    incl = fl.sales_in_range(sales, dt.date(2001, 7, 31), dt.date(2001, 7, 31))
    assert [r.id for r in incl.collect()] == [1, 2]                   # B14: both


def test_trend_zero_filled(spark):
    sales, _ = _shop(spark)
    rows = sal.trend(sales, dt.date(2001, 8, 1), 7).collect()
    assert len(rows) == 7 and str(rows[0].date) == "2001-07-25" and str(rows[-1].date) == "2001-07-31"
    assert [r.sales for r in rows] == [0, 0, 0, 0, 1, 0, 2]


def test_by_product_and_top(spark):
    sales, items = _shop(spark)
    rows = sal.sales_by_product(sales, items, dt.date(2001, 7, 1), dt.date(2001, 8, 1)).collect()
    assert [(r.product_sku, r.total_quantity) for r in rows] == [("a2", 6), ("a1", 2)]   # same name, two skus
    top = sal.quick_top(sales, items, dt.date(2001, 8, 1), 30, 5).collect()
    assert [(r.product, r.quantity) for r in top] == [("A", 8)]                       # one name
    s = sal.sales_by_product_summary(sales, items, dt.date(2001, 7, 1), dt.date(2001, 8, 1)).first()
    assert (s.total_products, s.top_product, s.top_product_revenue) == (2, "A", 26.01)


def test_inventory_edges(spark):
    p = products_df(spark, [
        {"id": 1, "sku": "s1", "name": "n1", "cost_price": D("100.00"), "selling_price": D("150.00"),
         "current_stock": 0, "category_id": 1, "supplier_id": 1},
        {"id": 2, "sku": "s2", "name": "n2", "cost_price": D("0.00"), "selling_price": D("1.00"),
         "current_stock": 10},
        {"id": 3, "sku": "s3", "name": "n3", "cost_price": D("1.00"), "selling_price": D("2.00"),
         "current_stock": 20, "is_active": None, "category_id": 1},
        {"id": 4, "sku": "s4", "name": "n4", "cost_price": D("1.00"), "selling_price": D("2.00"),
         "current_stock": 21, "is_active": False},
        {"id": 5, "sku": "s5", "name": "n5", "cost_price": D("1.00"), "selling_price": D("2.00"),
         "current_stock": 0, "min_stock_level": 0},
    ])
    cats, sups = dims(spark)
    rep = {r.product_id: r for r in inv.inventory_report(p, cats, sups).collect()}
    assert set(rep) == {1, 2, 5}                                      # NULL / False active dropped
    assert (rep[1].category, rep[2].category, rep[2].supplier) == ("Tools", "N/A", "N/A")
    assert rep[1].stock_status == "Out of Stock" and rep[2].stock_status == "Low Stock"
    assert {r.id for r in fl.low_stock(p).collect()} == {1, 2, 5}
    assert {r.id for r in fl.out_of_stock(p).collect()} == {1, 5}
    dist = {r.category: r.product_count for r in inv.category_distribution(cats, p).collect()}
    assert dist == {"Tools": 2, "Empty": 0}                           # inactive counted, empty kept
    s = inv.product_report_summary(p, cats, sups).first()
    assert s.total_products == 3 and s.categories_count == 2 and s.avg_margin == 75.0  # cost 0 skipped
    summ = inv.inventory_summary(p).first()
    assert (summ.total_products, summ.low_stock_count, summ.out_of_stock_count) == (3, 3, 2)


def test_search_wildcards_and_nulls(spark):
    p = products_df(spark, [
        {"id": 1, "sku": "a%b", "name": "Hammer", "cost_price": D("1"), "selling_price": D("2"),
         "current_stock": 1, "brand": None},
        {"id": 2, "sku": "axb", "name": "Saw", "cost_price": D("1"), "selling_price": D("2"),
         "current_stock": 1, "brand": "Bosch", "is_active": False},
    ])
    assert {r.id for r in fl.product_search(p, "ham").collect()} == {1}     # NULL brand does not block
    assert {r.id for r in fl.product_search(p, "a%b").collect()} == {1, 2}  # % is a wildcard
    assert {r.id for r in fl.product_search(p, "BOSCH").collect()} == {2}   # inactive included


def test_deep_page_equals_top_k(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("id"), (F.col("id") % 3).alias("g"))
    for order in (["id"], [F.desc("g"), F.asc("id")]):
        near = [tuple(r) for r in fl.page(df, order, skip=37, limit=50).collect()]
        deep = [tuple(r) for r in fl.page(df, order, skip=37, limit=50, deep_page=0).collect()]
        assert near == deep and len(deep) == 50
    tail = fl.page(df, ["id"], skip=490, deep_page=0).collect()
    assert [r.id for r in tail] == list(range(490, 500))
