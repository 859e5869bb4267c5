"""Data-quality rules fire on bad rows and stay quiet on good ones."""
from decimal import Decimal as D

from conftest import dims, items_df, products_df, sales_df
from pyspark.sql import functions as F

from stockline.operators import quality as dq


def test_rules(spark):
    p = products_df(spark, [
        {"id": 1, "sku": "ok", "name": "n", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 1},
        {"id": 2, "sku": "", "name": "n", "cost_price": D("3"), "selling_price": D("2"), "current_stock": -1,
         "max_stock_level": 5, "min_stock_level": 5, "barcode": "dup"},
        {"id": 3, "sku": "ok", "name": "n", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 1,
         "barcode": "dup", "category_id": 9},
    ])
    got = {(r.record_key, r.rule) for r in dq.dq_product_checks(p).collect()}
    assert got == {("2", "stock_non_negative"), ("2", "price_not_below_cost"), ("2", "max_above_min")}
    assert {(r.record_key, r.rule) for r in dq.dq_product_fields(p).collect()} == {("2", "sku_length")}
    cats, sups = dims(spark)
    sales = sales_df(spark, [{"id": 1, "payment_method": "gold"}, {"id": 2}])
    items = items_df(spark, [{"sale_id": 1, "product_id": 1, "quantity": 0}, {"sale_id": 7, "product_id": 1,
                                                                              "quantity": 1}])
    uniq = {(r.table_name, r.record_key) for r in dq.dq_unique({"products": p}).collect()}
    assert uniq == {("products", "ok"), ("products", "dup")}
    users = spark.createDataFrame([(1, "e", "u", None, True, False)], "id long, email string, username string, "
                                  "full_name string, is_active boolean, is_admin boolean")
    fk = {(r.record_key, r.rule) for r in dq.dq_foreign_keys(p, cats, sups, sales, items, users).collect()}
    assert fk == {("3", "fk_category"), ("7:1", "fk_sale")}
    lines = {(r.record_key, r.rule) for r in dq.dq_sale_lines(sales, items).collect()}
    assert lines == {("1:1", "quantity_positive"), ("2", "has_lines")}
    assert {(r.record_key, r.rule) for r in dq.dq_sales(sales).collect()} == {("1", "payment_method_known")}


def test_sale_lines_ids_are_dealt_by_rows(spark, monkeypatch):
    """Ids take next to no bytes in a shuffle, so partitions merged by bytes would hold them all."""
    from stockline import session
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 50)
    sales = sales_df(spark, [{"id": i} for i in range(200)] + [{"id": 200}, {"id": 200}])
    items = items_df(spark, [{"sale_id": i, "product_id": 1, "quantity": 1} for i in range(190)]
                     + [{"sale_id": s, "product_id": 1, "quantity": 1} for s in [5] * 100 + [-7] * 20 + [-9] * 20])
    items = items.withColumn("sale_id", F.expr("nullif(sale_id, -7)"))
    out = dq.dq_sale_lines(sales, items)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ", 11), REPARTITION_BY_NUM" in plan          # 202 sales and 330 lines
    got = sorted((r.record_key, r.rule) for r in out.collect())
    assert got == sorted([(str(i), "has_lines") for i in range(190, 200)] + [("200", "has_lines")] * 2)
