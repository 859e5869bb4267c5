"""J1-J8 on damaged tables: every rule finds rows, and only rows that were damaged."""
import pytest
from conftest import items_df, sales_df

from stockline.operators import quality as dq
from stockline.plans.registry import shop
from stockline.sources.dirty import DAMAGE, dirty_shop
from stockline.sources.tables import Shop

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def dirty(spark):
    return dirty_shop(shop(spark, SF))


def rules(df):
    return {r.rule for r in df.select("rule").distinct().collect()}


def test_every_row_rule_fires(dirty):
    assert rules(dq.dq_product_checks(dirty.products)) == {n for n, _ in dq.PRODUCT_CHECKS}
    assert rules(dq.dq_product_fields(dirty.products)) == {n for n, _ in dq.PRODUCT_FIELDS}
    assert rules(dq.dq_sales(dirty.sales)) == {n for n, _ in dq.SALE_CHECKS}
    assert rules(dq.dq_suppliers(dirty.suppliers)) == {n for n, _ in dq.SUPPLIER_CHECKS} | {"email_shape"}
    assert rules(dq.dq_sale_lines(dirty.sales, dirty.sale_items)) == {n for n, _ in dq.SALE_LINE_CHECKS} | {"has_lines"}


def test_every_table_rule_fires(dirty):
    assert rules(dq.dq_unique(dq.all_tables(dirty))) == {f"unique_{c}" for _, c in dq.UNIQUE}
    assert rules(dq.dq_foreign_keys(dirty.products, dirty.categories, dirty.suppliers, dirty.sales, dirty.sale_items, dirty.users)) == {
        "fk_category", "fk_supplier", "fk_sale", "fk_product", "fk_user"}
    missing = dq.dq_not_null(dq.all_tables(dirty)).select("table_name", "rule").distinct().collect()
    assert {tuple(r) for r in missing} == {(t, f"not_null_{c}") for t, cols in dq.NOT_NULL.items() for c in cols}


def test_line_ids_are_unique_and_stable(spark):
    items = shop(spark, SF).sale_items
    n = items.count()
    assert items.select("id").distinct().count() == n and items.where("id is null").count() == 0
    plan = items.groupBy("product_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan      # a plan that does not read the id does not number lines
    assert set(DAMAGE) == {"products", "sales", "sale_items", "suppliers", "categories", "users"}


def test_dirty_sale_lines_deal_ids_by_rows(spark, monkeypatch):
    from stockline import session
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 50)
    items = items_df(spark, [{"id": i, "sale_id": i // 2, "product_id": 1, "quantity": 1} for i in range(998)])
    dirty = dirty_shop(Shop({"sales": lambda: sales_df(spark, [{"id": i} for i in range(500)]), "sale_items": lambda: items}))
    out = dq.dq_sale_lines(dirty.sales, dirty.sale_items)
    assert ", 30), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    # Lines 5 and 504 lose their sale, 17 and 516 point nowhere; each of their sales has another line. Sale 499 has none.
    assert [r.record_key for r in out.where("rule = 'has_lines'").collect()] == ["499"]
