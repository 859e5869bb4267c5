"""H15 / H16 / I1 at full precision, against decimal arithmetic."""
import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal as D

from conftest import products_df

from stockline.functions.exprs import line_amounts, store_money
from stockline.operators import posting as po

CENT = D("0.01")


def amounts(price, qty, tax, disc):
    sub = D(str(price)) * qty
    discount = sub * (D(str(disc)) / D("100"))
    taxable = sub - discount
    t = taxable * (D(str(tax)) / D("100"))
    return sub, discount, t, taxable + t


def cents(x):
    return x.quantize(CENT, ROUND_HALF_UP)


def test_percents_of_any_digits(spark):
    rnd = random.Random(6)
    rows = [(D("10.00"), 1, 0.0, 33.33333), (D("1000000.00"), 1, 18.0, 33.33333), (D("99999.99"), 3, 100.0, 1e-7), (D("0.01"), 50, 0.5, 99.99999999999999),
            (D("150.00"), 1, 18.0, 5.0), (D("0.10"), 1, 5.0, 0.0), (D("99999999.99"), 1, 7.123456789012345, 33.333333333333336)]
    rows += [(D(rnd.randint(1, 10**7)) / 100, rnd.randint(1, 99), rnd.choice([rnd.random() * 100, round(rnd.random() * 30, 3), 0.0, 100.0]),
              rnd.choice([rnd.random() * 100, round(rnd.random() * 50, 5), 12.5])) for _ in range(3000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p decimal(10,2), q int, t double, d double")
    a = line_amounts("p", "q", "t", "d")
    got = df.select("i", *[store_money(a[k]).alias(k) for k in ("subtotal", "discount_amount", "tax_amount", "total")], a["discount_amount"].alias("exact")).collect()
    for r in got:
        sub, disc, tax, total = amounts(*rows[r.i])
        assert (r.subtotal, r.discount_amount, r.tax_amount, r.total) == (cents(sub), cents(disc), cents(tax), cents(total)), rows[r.i]
    assert {r.i: r.exact for r in got}[0] == D("3.333333")


def test_sale_totals_sum_unrounded_lines(spark):
    p = products_df(spark, [{"id": 1, "sku": "s", "name": "n", "cost_price": D("1"), "selling_price": D("2"), "current_stock": 5}])
    rows = [(1, 1, 1, D("10.00"), 7.77777, 33.33333)] * 30
    lines = spark.createDataFrame(rows, "request_id long, product_id long, quantity int, unit_price decimal(10,2), tax_rate double, discount_percent double")
    heads = spark.createDataFrame([(1, dt.datetime(2001, 1, 1))], "request_id long, sale_date timestamp_ntz")
    r = po.priced_sales(lines, heads, p).first()
    sub, disc, tax, _ = (sum(x) for x in zip(*[amounts(D("10.00"), 1, 7.77777, 33.33333)] * 30))
    assert (r.total_amount, r.tax_amount, r.discount_amount, r.grand_total) == (cents(sub), cents(tax), cents(disc), cents(sub + tax - disc))
