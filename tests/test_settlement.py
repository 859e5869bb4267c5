"""I4 and I10 as ordered jobs: against one-at-a-time replays, with hot products and missing values."""
import datetime as dt
import random
from decimal import Decimal as D

from conftest import products_df, sales_df
from test_posting import _run, sequential

from stockline.operators import posting as po
from stockline.operators import snapshots as sn
from stockline.operators.settlement import MSG_BAD_QUANTITY, MSG_NO_PRODUCT
from stockline.plans.components import component_marks
from stockline.plans.fold import conditional_fold


def test_hot_scarce_product_settles_in_slices(spark):
    rnd = random.Random(11)
    stock = {1: 300, **{p: rnd.randint(3, 9) for p in range(2, 30)}}
    # Every third sale asks for the hot product; slices of five sales cut its component many times.
    sales = [(s, ([(1, rnd.randint(1, 9))] if s % 3 == 0 else []) + [(rnd.randint(2, 29), rnd.randint(1, 4))]) for s in range(1, 400)]
    want, left = sequential(stock, sales)
    got, got_stock, _ = _run(spark, stock, sales, screening_rounds=1, chunk_sales=5)
    assert got == want and got_stock == left


def test_long_chain_of_conflicts(spark):
    # Each sale shares one scarce unit with the next: every other one is accepted.
    sales = [(s, [(s, 1), (s + 1, 1)]) for s in range(1, 60)]
    want, left = sequential({p: 1 for p in range(1, 61)}, sales)
    got, got_stock, _ = _run(spark, {p: 1 for p in range(1, 61)}, sales, screening_rounds=2)
    assert got == want and got_stock == left and sum(got.values()) == 30


def test_bad_lines_are_refused_by_name(spark):
    acc, stock, msg = _run(spark, {1: 10}, [(1, [(1, None)]), (2, [(1, -4)]), (3, [(None, 1)]), (4, [(1, 0)]), (5, [(1, 10)]), (6, [])])
    assert acc == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False} and stock == {1: 0}
    assert [msg[i] for i in range(1, 5)] == [MSG_BAD_QUANTITY, MSG_BAD_QUANTITY, MSG_NO_PRODUCT, MSG_BAD_QUANTITY]
    assert msg[6] == po.MSG_NO_ITEMS


def test_posted_rows(spark):
    p = products_df(spark, [{"id": 7, "sku": "s7", "name": "n7", "barcode": "b7", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 5}])
    old = sales_df(spark, [{"id": 40, "sale_number": "SAL-20010801-999"}])
    lines = spark.createDataFrame([(1, 7, 2, D("75.00"), 18.0, 5.0), (2, 7, 9, D("1.00"), 0.0, 0.0), (3, 7, 3, D("1.00"), 0.0, 0.0)],
                                  "request_id long, product_id long, quantity int, unit_price decimal(10,2), tax_rate double, discount_percent double")
    day = dt.datetime(2001, 8, 1)
    headers = spark.createDataFrame([(1, day, "cash", "Ann"), (2, day, "cash", None), (3, day, "card", None)],
                                    "request_id long, sale_date timestamp_ntz, payment_method string, customer_name string")
    now = dt.datetime(2001, 8, 2)
    out = po.post_sales_tables(lines, headers, p, old, now)
    rows = {r.id: r for r in out.sales.collect()}
    assert sorted(rows) == [41, 42]
    assert (rows[41].sale_number, rows[42].sale_number) == ("SAL-20010801-1000", "SAL-20010801-1001")
    assert (rows[41].total_amount, rows[41].discount_amount, rows[41].tax_amount, rows[41].grand_total) == (
        D("150.00"), D("7.50"), D("25.65"), D("168.15"))
    assert (rows[41].payment_status, rows[42].payment_status, rows[41].customer_name) == ("paid", "pending", "Ann")
    items = sorted(out.sale_items.collect())
    assert [(i.sale_id, i.quantity, i.total, i.product_name, i.product_barcode, i.created_at) for i in items] == [
        (41, 2, D("168.15"), "n7", "b7", now), (42, 3, D("3.00"), "n7", "b7", now)]
    assert out.products.first().current_stock == 0
    assert {r.request_id: r.accepted for r in out.results.collect()} == {1: True, 2: False, 3: True}


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in component_marks(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def replay(stock, changes):
    out = []
    for rid, pid, q in changes:
        ok = pid in stock and q is not None and stock[pid] + q >= 0
        if ok:
            stock[pid] += q
        out.append((rid, ok))
    return dict(out), stock


def test_several_changes_of_a_product(spark):
    p = products_df(spark, [{"id": i, "sku": f"s{i}", "name": "n", "cost_price": D("1"), "selling_price": D("2"), "current_stock": s}
                            for i, s in ((1, 5), (2, 0))])
    changes = [(1, 1, 5), (2, 1, -12), (3, 1, 3), (4, 1, -13), (5, 2, -1), (6, 2, 1), (7, 2, -1), (8, 9, 1), (9, 1, None), (10, None, 1)]
    want, left = replay({1: 5, 2: 0}, changes)
    now = dt.datetime(2001, 8, 1)
    new, res = sn.adjust_stock(p, spark.createDataFrame(changes, "request_id long, product_id long, quantity int"), now)
    assert {r.request_id: r.accepted for r in res.collect()} == want
    assert {r.id: r.current_stock for r in new.collect()} == left
    # A given sequence goes before the request's id.
    turned = spark.createDataFrame([(1, 2, -1, 2), (2, 2, 1, 1)], "request_id long, product_id long, quantity int, seq int")
    assert {r.request_id: r.accepted for r in sn.adjust_stock(p, turned, now)[1].collect()} == {1: True, 2: True}


def test_fold_of_a_hot_group_over_many_ranges(spark):
    rnd = random.Random(8)
    stock = {1: 20, 2: 3, 3: 0, 4: 10**6}
    changes = [(i, 1 if i % 2 else rnd.randint(2, 4), rnd.choice([-7, -3, -1, 1, 2, 6, None])) for i in range(4000)]
    want, _ = replay(dict(stock), changes)
    df = spark.createDataFrame([(i, g, c, stock[g]) for i, g, c in changes], "i long, g long, c int, s long").repartition(5)
    out = conditional_fold(df, "g", ["i"], "c", "s", partitions=23).collect()
    assert {r.i: r.accepted for r in out} == want and len(out) == 4000
    balance = dict(stock)
    for r in sorted(out):
        balance[r.g] += r.c if r.accepted else 0
        assert r.balance == balance[r.g]
    assert conditional_fold(df.limit(0), "g", ["i"], "c", "s").count() == 0


def test_fold_goes_through_batches_and_stays_exact(spark):
    """Python holds one Arrow batch, and a refused NULL change does not turn its neighbours into floats."""
    big = 2 ** 53 + 1
    rows = [(1, i, c, 0) for i, c in enumerate([big, None, -1, -big, 2])] + [(2, i, -1, 7) for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = conditional_fold(spark.createDataFrame(rows, "g long, i long, c long, s long"), "g", ["i"], "c", "s", partitions=5)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.g, r.i): (r.accepted, r.balance) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "Join" not in plan
    assert [got[1, i] for i in range(5)] == [(True, big), (False, big), (True, big - 1), (False, big - 1), (True, big + 1)]
    assert [got[2, i] for i in range(100)] == [(i < 7, max(6 - i, 0)) for i in range(100)]


def _small_batch(spark):
    p = products_df(spark, [{"id": i, "sku": f"s{i}", "name": f"n{i}", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 5} for i in (1, 2)])
    t0 = dt.datetime(2001, 1, 1)
    headers = spark.createDataFrame([(1, t0), (1, t0), (2, t0), (3, t0)], "request_id long, sale_date timestamp_ntz")
    lines = spark.createDataFrame([(1, 1, 2), (1, 1, 1), (2, 1, 3), (3, 2, 5)], "request_id long, product_id long, quantity int")
    return lines.selectExpr("*", "cast(1 as decimal(10,2)) unit_price", "0D tax_rate", "0D discount_percent"), headers, p


def test_posting_reads_the_lines_once(spark, tmp_path):
    """Stock is lowered by the stored lines that decided the sales; a header that comes twice takes its units once."""
    lines, headers, p = _small_batch(spark)
    lines.write.parquet(str(tmp_path / "given_lines"))
    new, result = po.post_sales(spark.read.parquet(str(tmp_path / "given_lines")), headers.where("request_id <> 2"), p)
    assert "given_lines" not in new._jdf.queryExecution().toString()
    accepted = {r.request_id for r in result.where("accepted").collect()}
    assert 3 in accepted
    assert {r.id: r.current_stock for r in new.collect()} == {1: 2 if 1 in accepted else 5, 2: 0}


def test_lines_are_numbered_when_asked_for(spark, monkeypatch):
    numbered, plain = [], po.running_totals
    monkeypatch.setattr(po, "running_totals", lambda df, group, *a, **k: numbered.append(group) or plain(df, group, *a, **k))
    lines, headers, p = _small_batch(spark)
    out = po.post_sales_tables(lines, headers.distinct(), p, sales_df(spark, [{"id": 10}]))
    assert sorted(r.id for r in out.sales.select("id").collect()) == [11, 12] and ["sale_id"] not in numbered
    assert sorted((r.sale_id, r.quantity) for r in out.sale_items.collect()) == [(11, 1), (11, 2), (12, 5)]
    assert out.sale_items is out.sale_items and numbered.count(["sale_id"]) == 1
