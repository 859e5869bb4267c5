"""Posting (I4) against a plain sequential loop, and the other I operators."""
import datetime as dt
import random
from decimal import Decimal as D

from conftest import items_df, products_df, sales_df

from stockline.operators import posting as po
from stockline.operators import snapshots as sn


def sequential(stock, sales):
    """The reference's rule, one sale at a time: all lines or nothing."""
    stock = dict(stock)
    out = {}
    for sid, lines in sales:
        tmp = dict(stock)
        ok = True
        for pid, q in lines:
            if pid not in tmp or tmp[pid] < q:
                ok = False
                break
            tmp[pid] -= q
        if ok:
            stock = tmp
        out[sid] = ok
    return out, stock


def _run(spark, stock, sales, **kw):
    p = products_df(spark, [{"id": pid, "sku": f"s{pid}", "name": f"n{pid}", "cost_price": D("1"),
                             "selling_price": D("2"), "current_stock": s} for pid, s in stock.items()])
    lines = spark.createDataFrame(
        [(sid, pid, q, D("1.00"), 0.0, 0.0) for sid, ls in sales for pid, q in ls],
        "request_id long, product_id long, quantity int, unit_price decimal(10,2), tax_rate double, "
        "discount_percent double")
    headers = spark.createDataFrame([(sid, dt.datetime(2001, 1, 1) + dt.timedelta(minutes=sid)) for sid, _ in sales],
                                    "request_id long, sale_date timestamp_ntz")
    new_p, res = po.post_sales(lines, headers, p, **kw)
    return ({r.request_id: r.accepted for r in res.collect()},
            {r.id: r.current_stock for r in new_p.collect()}, {r.request_id: r.message for r in res.collect()})


def test_fixture_case(spark):
    # A takes 6 and 6 of two products (stock 10, 5): refused, nothing taken; B takes 6 of the first: accepted.
    acc, stock, msg = _run(spark, {1: 10, 2: 5}, [(1, [(1, 6), (2, 6)]), (2, [(1, 6)])])
    assert acc == {1: False, 2: True} and stock == {1: 4, 2: 5}
    assert msg[1].startswith("Insufficient stock for n2") and msg[2] == "Sale created successfully"
    # same product twice in one sale, 6 + 6 of 10: refused; unknown product: refused
    acc, stock, msg = _run(spark, {1: 10}, [(1, [(1, 6), (1, 6)]), (2, [(9, 1)])])
    assert acc == {1: False, 2: False} and stock == {1: 10} and msg[2] == "Product ID 9 not found"


def test_against_sequential_loop(spark):
    rnd = random.Random(7)
    for trial in range(4):
        stock = {pid: rnd.randint(0, 12) for pid in range(1, 7)}
        sales = [(sid, [(rnd.randint(1, 7), rnd.randint(1, 5)) for _ in range(rnd.randint(1, 3))])
                 for sid in range(1, 40)]
        want, want_stock = sequential(stock, sales)
        # few screening rounds and tiny chunks, to exercise the in-order settlement across chunks
        got, got_stock, _ = _run(spark, stock, sales, screening_rounds=1 + trial % 2, chunk_sales=7)
        assert got == want
        assert got_stock == {k: v for k, v in want_stock.items()}


def test_cancel_patch_delete(spark):
    sales = sales_df(spark, [{"id": 1, "status": "completed", "payment_status": "paid"},
                             {"id": 2, "status": "cancelled"},
                             {"id": 3, "status": "draft", "customer_name": "x"}])
    items = items_df(spark, [{"sale_id": 1, "product_id": 1, "quantity": 2},
                             {"sale_id": 3, "product_id": 1, "quantity": 1}])
    p = products_df(spark, [{"id": 1, "sku": "s", "name": "n", "cost_price": D("1"), "selling_price": D("2"),
                             "current_stock": 5}])
    req = spark.createDataFrame([(1,), (2,), (9,)], "request_id long")
    new_s, new_p, res = po.cancel_sales(sales, items, p, req)
    assert {r.request_id: r.accepted for r in res.collect()} == {1: True, 2: False, 9: False}
    assert new_p.first().current_stock == 7
    assert {r.id: (r.status, r.payment_status) for r in new_s.collect()}[1] == ("cancelled", "refunded")
    patches = spark.createDataFrame([(3, None, True, "n", False), (1, "y", True, None, False)],
                                    "request_id long, customer_name string, set_customer_name boolean, "
                                    "notes string, set_notes boolean")
    ps, pres = po.patch_sales(sales, patches)
    got = {r.id: r.customer_name for r in ps.collect()}
    assert got[3] is None and got[1] is None and {r.request_id: r.accepted for r in pres.collect()} == {3: True, 1: False}
    ds, di, dres = po.delete_drafts(sales, items, spark.createDataFrame([(3,), (1,)], "request_id long"))
    assert {r.id for r in ds.collect()} == {1, 2} and di.count() == 1


def test_stock_changes_and_products(spark):
    p = products_df(spark, [{"id": 1, "sku": "s1", "name": "n", "cost_price": D("1"), "selling_price": D("2"),
                             "current_stock": 50, "barcode": "b1"},
                            {"id": 2, "sku": "s2", "name": "m", "cost_price": D("1"), "selling_price": D("2"),
                             "current_stock": 0}])
    ch = spark.createDataFrame([(1, 1, -60), (2, 2, 5), (3, 9, 1)], "request_id long, product_id long, quantity int")
    now = dt.datetime(2001, 8, 1, 12)
    new_p, flags = sn.bulk_stock(p, ch, now)
    assert {r.product_id: r.success for r in flags.collect()} == {1: False, 2: True, 9: False}
    got = {r.id: (r.current_stock, r.last_restocked) for r in new_p.collect()}
    assert got == {1: (50, None), 2: (5, now)}
    cats = spark.createDataFrame([(1, "c", None, None, None)], "id long, name string, description string, "
                                 "created_at timestamp_ntz, updated_at timestamp_ntz")
    sups = cats.select("id", "name")
    req = spark.createDataFrame([(10, "s1", "x", D("1.00"), D("2.00"), None, 3, None),
                                 (11, "new", "y", D("0.00"), D("2.00"), "b1", 0, None),
                                 (12, "new2", "z", D("4.00"), D("5.00"), None, 4, 1),
                                 (13, "new2", "w", D("4.00"), D("5.00"), None, 4, None)],
                                "request_id long, sku string, name string, cost_price decimal(10,2), "
                                "selling_price decimal(10,2), barcode string, current_stock int, category_id long")
    out, res = sn.add_products(p, cats, sups, req, now)
    msgs = {r.request_id: r.message for r in res.collect()}
    assert msgs == {10: sn.MSG_SKU_EXISTS, 11: sn.MSG_BARCODE_EXISTS, 12: "ok", 13: sn.MSG_SKU_EXISTS}
    new = out.where("id > 2").collect()
    assert len(new) == 1 and new[0].id == 3 and new[0].margin == 25.0 and new[0].last_restocked == now


def test_lineless_sale_refused(spark):
    p = products_df(spark, [{"id": 1, "sku": "s", "name": "n", "cost_price": D("1"), "selling_price": D("2"),
                             "current_stock": 5}])
    lines = spark.createDataFrame([(1, 1, 2, D("1.00"), 0.0, 0.0)],
                                  "request_id long, product_id long, quantity int, unit_price decimal(10,2), "
                                  "tax_rate double, discount_percent double")
    headers = spark.createDataFrame([(1, dt.datetime(2001, 1, 1)), (2, dt.datetime(2001, 1, 2))],
                                    "request_id long, sale_date timestamp_ntz")
    _, res = po.post_sales(lines, headers, p)
    got = {r.request_id: (r.accepted, r.message) for r in res.collect()}
    assert got == {1: (True, po.MSG_CREATED), 2: (False, po.MSG_NO_ITEMS)}


def test_real_data_matches_sequential_loop(spark):
    """The registered posting query on the driver's sf0.001 tables equals the
    reference's one-sale-at-a-time rule replayed in plain Python."""
    import os

    import duckdb

    from oracle_views import with_views
    from stockline.plans.registry import all_queries
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    con = duckdb.connect()
    for t in ["customer", "supplier", "part", "orders", "lineitem", "nation"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    order = [r[0] for r in con.execute(with_views(
        "SELECT id FROM sales WHERE status = 'draft' ORDER BY sale_date, id")).fetchall()]
    lines = con.execute(with_views("SELECT sale_id, product_id, quantity FROM sale_items "
                                   "WHERE sale_id IN (SELECT id FROM sales WHERE status = 'draft')")).fetchall()
    stock = dict(con.execute(with_views("SELECT id, current_stock FROM products")).fetchall())
    by_sale = {}
    for s, pid, q in lines:
        by_sale.setdefault(s, []).append((pid, q))
    want, stock = sequential(stock, [(s, by_sale.get(s, [])) for s in order])
    for s in order:                      # a sale without lines is refused (at least one item)
        if not by_sale.get(s):
            want[s] = False
    q = all_queries()
    got = {r.request_id: r.accepted for r in q["post_sales"](spark, sf).collect()}
    assert got == want
    assert {r.id: r.current_stock for r in q["post_sales_stock"](spark, sf).collect()} == stock
