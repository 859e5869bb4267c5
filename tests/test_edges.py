"""Remaining FIXTURES.md edge cases."""
import datetime as dt
from decimal import Decimal as D

from conftest import items_df, sales_df

from stockline.operators import joins as jn
from stockline.operators import posting as po
from stockline.operators import sales as sal


def test_sale_numbers_after_999(spark):
    existing = sales_df(spark, [{"id": 1, "sale_number": "SAL-20010801-999"},
                                {"id": 2, "sale_number": "SAL-20010801-1000"},
                                {"id": 3, "sale_number": "SAL-20010731-007"}])
    new = spark.createDataFrame([(10, dt.datetime(2001, 8, 1, 9)), (11, dt.datetime(2001, 8, 1, 8)),
                                 (12, dt.datetime(2001, 7, 31, 8)), (13, dt.datetime(2001, 7, 30, 8))],
                                "request_id long, sale_date timestamp_ntz")
    got = {r.request_id: r.sale_number for r in po.sale_numbers(new, existing).collect()}
    assert got == {11: "SAL-20010801-1001", 10: "SAL-20010801-1002", 12: "SAL-20010731-008",
                   13: "SAL-20010730-001"}


def test_sale_without_lines_has_empty_items(spark):
    sales = sales_df(spark, [{"id": 1}, {"id": 2}])
    items = items_df(spark, [{"sale_id": 1, "product_id": 5, "quantity": 2}])
    rows = {r.id: r.items for r in jn.sale_with_items(sales, items).collect()}
    assert len(rows[1]) == 1 and rows[1][0].product_id == 5 and rows[2] == []


def test_big_sale_split_into_bounded_parts(spark):
    sales = sales_df(spark, [{"id": 1}])
    items = items_df(spark, [{"sale_id": 1, "product_id": p, "quantity": 1} for p in range(25)])
    rows = jn.sale_with_items(sales, items, chunk_lines=10).collect()
    assert len(rows) == 3 and sum(len(r.items) for r in rows) == 25     # k = ceil(25 / 10) parts, no line lost
    assert sorted(i.product_id for r in rows for i in r.items) == list(range(25))


def test_ties_at_the_cut_broken_by_key(spark):
    sales = sales_df(spark, [{"id": 1, "sale_date": dt.datetime(2001, 7, 31)}])
    items = items_df(spark, [{"sale_id": 1, "product_id": p, "quantity": 3, "total": D("1.00"),
                              "product_name": f"n{p}", "product_sku": f"s{p}"} for p in (4, 2, 9, 7)])
    top = sal.top_by_quantity(sales, items, dt.date(2001, 8, 1), 30, 2).collect()
    assert [r.product_id for r in top] == [2, 4]
    five = sal.quick_top(sales, items, dt.date(2001, 8, 1), 30, 3).collect()
    assert [r.product for r in five] == ["n2", "n4", "n7"]
