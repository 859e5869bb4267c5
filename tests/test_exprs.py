"""Scalar expressions against hand-computed values (FIXTURES.md)."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockline.functions import exprs as X


def test_week_key_sunday_first(spark):
    df = spark.createDataFrame([(dt.date(1995, 1, 1),), (dt.date(1996, 1, 1),), (dt.date(2000, 12, 31),)], "d date")
    got = [r[0] for r in df.select(X.week_key("d")).collect()]
    assert got == ["1995-W01", "1996-W00", "2000-W53"]
    # Python's own %U over a year of days agrees.
    days = [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(X.week_key("d")).collect()]
    assert got == [d.strftime("%Y-W%U") for d in days]


def test_margin_and_status(spark):
    df = spark.createDataFrame([(Decimal("150.00"), Decimal("100.00")), (Decimal("75.00"), Decimal("50.00")),
                                (Decimal("49.99"), Decimal("25.00")), (Decimal("10.00"), Decimal("0.00"))],
                               "s decimal(10,2), c decimal(10,2)")
    got = [r[0] for r in df.select(X.margin_percent("s", "c")).collect()]
    assert got[:3] == [50.0, 50.0, 99.96] and got[3] is None
    st = spark.createDataFrame([(0, 10), (10, 10), (20, 10), (21, 10), (0, 0)], "s int, m int")
    assert [r[0] for r in st.select(X.stock_status("s", "m")).collect()] == [
        "Out of Stock", "Low Stock", "Adequate", "Over Stock", "Out of Stock"]


def test_line_amounts_fixture(spark):
    """2 x 75.00 at tax 18 %, discount 5 %: 150.00 / 7.50 / 142.50 / 25.65 / 168.15."""
    df = spark.createDataFrame([(Decimal("75.00"), 2, 18.0, 5.0)], "p decimal(10,2), q int, t double, d double")
    a = X.line_amounts("p", "q", "t", "d")
    r = df.select(*[X.store_money(a[k]).alias(k) for k in ("subtotal", "discount_amount", "taxable",
                                                          "tax_amount", "total")]).first()
    assert (r.subtotal, r.discount_amount, r.taxable, r.tax_amount, r.total) == (
        Decimal("150.00"), Decimal("7.50"), Decimal("142.50"), Decimal("25.65"), Decimal("168.15"))


def test_labels(spark):
    df = spark.createDataFrame([(None, "u1", None), ("", "u2", ""), ("Full", "u3", "Bob")],
                               "full string, user string, cust string")
    r = df.select(X.display_name("full", "user"), X.customer_label("cust")).collect()
    assert [tuple(x) for x in r] == [("u1", "Walk-in"), ("u2", "Walk-in"), ("Full", "Bob")]
    n = spark.createDataFrame([("SAL-20010801-999",), ("SAL-20010801-1000",), ("junk",)], "n string")
    assert [r[0] for r in n.select(X.sale_number_seq("n")).collect()] == [999, 1000, None]
    d = spark.createDataFrame([(dt.date(2001, 8, 1), 7)], "d date, s int")
    assert d.select(X.sale_number("d", "s")).first()[0] == "SAL-20010801-007"
    assert d.select(X.sale_number("d", F.lit(1234))).first()[0] == "SAL-20010801-1234"


def test_input_price_half_even(spark):
    df = spark.createDataFrame([(Decimal("2.345"),), (Decimal("2.355"),), (Decimal("49.994"),)], "p decimal(10,3)")
    assert [r[0] for r in df.select(X.input_price("p")).collect()] == [
        Decimal("2.34"), Decimal("2.36"), Decimal("49.99")]
