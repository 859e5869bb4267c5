"""Scalar expressions (Column -> Column), all built-in Spark functions.

Nothing here leaves the JVM: every helper returns a Catalyst expression that
whole-stage code generation can fuse with its neighbours.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockline import schema as S

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- literals

def date_lit(d: _dt.date | str) -> Column:
    if isinstance(d, _dt.datetime):
        d = d.date()
    return F.lit(str(d)).cast("date")


def stamp_updated(df, changed, now):
    """``df`` with ``updated_at = now`` where ``changed``; as it is without ``now`` or without the column."""
    if now is None or "updated_at" not in df.columns:
        return df
    return df.withColumn("updated_at", F.when(changed, ts_lit(now)).otherwise(F.col("updated_at")))


def ts_lit(t: _dt.date | _dt.datetime | str) -> Column:
    """Wall-clock timestamp literal (``timestamp_ntz``), never shifted by the
    session time zone. A date means its midnight."""
    if isinstance(t, _dt.datetime):
        text = t.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(t, _dt.date):
        text = f"{t.isoformat()} 00:00:00"
    else:
        text = str(t)
    return F.lit(text).cast("timestamp_ntz")


def as_of_parts(as_of: _dt.date | _dt.datetime) -> tuple[_dt.date, _dt.datetime]:
    """(today, now) for an explicit as-of value; a date means its midnight."""
    if isinstance(as_of, _dt.datetime):
        return as_of.date(), as_of
    return as_of, _dt.datetime.combine(as_of, _dt.time())


# ---------------------------------------------------------------- H4-H8 dates

def day_of(ts: ColumnOrName) -> Column:
    """H4: timestamp -> calendar date."""
    return F.to_date(_c(ts))


def week_key(d: ColumnOrName) -> Column:
    """H5: ``%Y-W%U``, Sunday-first week of the calendar year (00-53).
    ``weekofyear`` would be the ISO week and is not the same."""
    d = _c(d)
    week = F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")
    return F.format_string("%d-W%02d", F.year(d), week)


def month_key(d: ColumnOrName) -> Column:
    """H6: ``%Y-%m``."""
    return F.date_format(_c(d), "yyyy-MM")


def span_days(start: _dt.date, end: _dt.date) -> int:
    """H7: inclusive span in days."""
    return (end - start).days + 1


# ---------------------------------------------------------------- money

def to_double(c: ColumnOrName) -> Column:
    """Decimal -> double, as the reports expose it."""
    return _c(c).cast("double")


def mean_money(total: ColumnOrName, n: ColumnOrName) -> Column:
    """H20 + H22: mean of money rounded half up to the cent, 0 when n = 0.

    ``total`` is an exact decimal sum; the quotient is kept decimal and only
    the rounded value becomes a double (a rounded double mean is not stable on
    half-cent ties)."""
    total, n = _c(total), _c(n)
    return F.when(n > 0, (total / n).cast("decimal(20,2)")).otherwise(
        F.lit(Decimal("0.00"))).cast("double")


def ratio(total: ColumnOrName, n: ColumnOrName) -> Column:
    """Plain double ratio of an exact sum by a count, 0 when n = 0."""
    total, n = _c(total), _c(n)
    return F.when(n > 0, total.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def margin_percent(selling: ColumnOrName, cost: ColumnOrName) -> Column:
    """H1: (price - cost) / cost * 100, NULL when cost <= 0.

    Both operands are scaled to whole numbers (cents) before the one double
    division, so the result is the correctly rounded exact ratio."""
    selling, cost = _c(selling), _c(cost)
    num = ((selling - cost) * F.lit(10000)).cast("double")
    den = (cost * F.lit(100)).cast("double")
    return F.when(cost > 0, num / den)


def stock_status(stock: ColumnOrName, minimum: ColumnOrName) -> Column:
    """H2: Out of Stock / Low Stock / Adequate / Over Stock (uses 2 x min)."""
    stock, minimum = _c(stock), _c(minimum)
    return (F.when(stock == 0, F.lit(S.STOCK_STATUS_OUT))
            .when(stock <= minimum, F.lit(S.STOCK_STATUS_LOW))
            .when(stock <= minimum * 2, F.lit(S.STOCK_STATUS_ADEQUATE))
            .otherwise(F.lit(S.STOCK_STATUS_OVER)))


def stock_value(stock: ColumnOrName, price: ColumnOrName) -> Column:
    """H3: exact stock x price (decimal)."""
    return _c(stock).cast("decimal(10,0)") * _c(price)


def or_na(name: ColumnOrName, key: ColumnOrName) -> Column:
    """H9: name of the related row, 'N/A' when there is none."""
    return F.when(_c(key).isNull(), F.lit(S.NOT_AVAILABLE)).otherwise(_c(name))


def display_name(full_name: ColumnOrName, username: ColumnOrName) -> Column:
    """``full_name or username``; an empty name counts as missing."""
    return F.coalesce(F.nullif(_c(full_name), F.lit("")), _c(username))


def customer_label(name: ColumnOrName) -> Column:
    """``customer_name || 'Walk-in'``."""
    return F.coalesce(F.nullif(_c(name), F.lit("")), F.lit(S.WALK_IN))


def reorder_flag(stock: ColumnOrName, minimum: ColumnOrName) -> Column:
    """Stock at or below its minimum."""
    return _c(stock) <= _c(minimum)


def active_label(is_active: ColumnOrName) -> Column:
    """H14: 'Active' / 'Inactive' (NULL counts as inactive, as in a page)."""
    return F.when(F.coalesce(_c(is_active), F.lit(False)), F.lit("Active")).otherwise(F.lit("Inactive"))


def percent_decimal(p: ColumnOrName) -> Column:
    """A double percentage as the decimal its text shows (``Decimal(str(x))``), up to 17 decimals."""
    return _c(p).cast("string").cast("decimal(20,17)")


def _percent_of(amount: Column, percent: Column) -> Column:
    """``amount`` x ``percent`` / 100 with 21 decimals. The percent's whole and fractional parts are multiplied apart:
    one product of both would need more than the 38 digits a decimal has."""
    whole = F.floor(percent).cast("decimal(3,0)")
    rest = (percent - whole).cast("decimal(17,17)")
    product = (amount * whole).cast("decimal(32,19)") + (amount * rest).cast("decimal(32,19)")
    return (product * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(34,21)")


def line_amounts(unit_price: ColumnOrName, quantity: ColumnOrName,
                 tax_rate: ColumnOrName, discount_percent: ColumnOrName) -> dict[str, Column]:
    """Line amounts for percents of any digits a double prints, exact to the cent. The discount is exact; the tax is
    taken of the taxable amount to 17 decimals, as fine as the 28 digits of decimal arithmetic.

    subtotal = price x qty; discount = subtotal x d% ; taxable = subtotal - discount;
    tax = taxable x t% ; total = taxable + tax. Rounding to cents happens only
    when a value is stored (``cast('decimal(10,2)')`` rounds half up).
    """
    subtotal = (_c(unit_price) * _c(quantity).cast("decimal(10,0)")).cast("decimal(20,2)")
    discount = _percent_of(subtotal, percent_decimal(discount_percent))
    taxable = (subtotal.cast("decimal(34,21)") - discount).cast("decimal(34,21)")
    tax = _percent_of(taxable.cast("decimal(30,17)"), percent_decimal(tax_rate))
    total = taxable + tax
    return {"subtotal": subtotal, "discount_amount": discount, "taxable": taxable,
            "tax_amount": tax, "total": total}


def input_price(c: ColumnOrName) -> Column:
    """A price given on input, rounded to 2 places half-even (Python's
    ``round`` of a Decimal), then stored as DEC(10,2)."""
    return F.bround(_c(c).cast("decimal(20,6)"), 2).cast(S.MONEY)


def store_money(c: ColumnOrName) -> Column:
    """Store an exact amount as DEC(10,2) (half up)."""
    return _c(c).cast(S.MONEY)


def auto_payment_status(method: ColumnOrName, status: ColumnOrName,
                        requested: ColumnOrName) -> Column:
    """Cash + completed -> 'paid', else the requested payment status."""
    return F.when((_c(method) == "cash") & (_c(status) == "completed"), F.lit("paid")).otherwise(_c(requested))


def cancel_payment_status(payment_status: ColumnOrName) -> Column:
    """Paid -> refunded, anything else -> pending."""
    return F.when(_c(payment_status) == "paid", F.lit("refunded")).otherwise(F.lit("pending"))


def sale_number(day: ColumnOrName, seq: ColumnOrName) -> Column:
    """``SAL-YYYYMMDD-NNN`` (at least three digits)."""
    return F.format_string("SAL-%s-%03d", F.date_format(_c(day), "yyyyMMdd"), _c(seq))


def sale_number_seq(number: ColumnOrName) -> Column:
    """Numeric last segment of a sale number (NULL when not a number)."""
    return F.element_at(F.split(_c(number), "-"), -1).try_cast("bigint")


def contains_ci(c: ColumnOrName, term: str) -> Column:
    """Case-insensitive ``ILIKE '%term%'``; ``%`` and ``_`` in the term
    stay wildcards, as in the SQL the reference builds."""
    return _c(c).ilike(f"%{term}%")
