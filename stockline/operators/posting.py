"""Sales posting as set-based batch jobs: I1-I7.

The reference changes one sale at a time inside a database transaction. Here
each operator takes the current tables plus a DataFrame of requests and
returns new table snapshots plus a result frame ``(request_id, accepted,
message)``. Nothing is updated in place; callers write snapshots to a new
path (:mod:`stockline.sources.sinks`).

Request frames:
- sale lines: ``request_id, product_id, quantity, unit_price, tax_rate, discount_percent``
- sale headers: ``request_id, sale_date`` (+ optional customer_name,
  payment_method, payment_status, status, user_id ...)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.functions.exprs import (auto_payment_status, cancel_payment_status, day_of,
                                       line_amounts, sale_number, sale_number_seq, stamp_updated, store_money, ts_lit)
from stockline.operators.settlement import MSG_BAD_QUANTITY, MSG_NO_PRODUCT, collapsed_lines, decide
from stockline.plans.ordered import running_totals
from stockline.schema import LINES_PER_SALE, SALE_ITEMS, SALES, conform
from stockline.session import cut_lineage

# Fixed messages (as the reference words them).
MSG_CREATED = "Sale created successfully"
MSG_NOT_FOUND = "Product ID %d not found"
MSG_INSUFFICIENT = "Insufficient stock for %s. Available: %d"
MSG_SALE_NOT_FOUND = "Sale not found"
MSG_ALREADY_CANCELLED = "Sale is already cancelled"
MSG_CANCELLED = "Sale cancelled successfully"
MSG_UPDATED = "Sale updated successfully"
MSG_CANNOT_UPDATE = "Cannot update %s sale"
MSG_NO_ITEMS = "At least one item required"   # our own wording (schema rule)


# ---------------------------------------------------------------- I1

def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Price each requested line (H15) and copy the product's name, sku
    and barcode into it (a snapshot at sale time). Lines of unknown
    products are dropped here; :func:`stock_check` reports them."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                        F.col("sku").alias("product_sku"), F.col("barcode").alias("product_barcode"))
    j = lines.join(p, "product_id", "inner")
    a = line_amounts("unit_price", "quantity", "tax_rate", "discount_percent")
    return j.select(
        "request_id", "product_id", "quantity", "unit_price", "tax_rate",
        store_money(a["tax_amount"]).alias("tax_amount"), "discount_percent",
        store_money(a["discount_amount"]).alias("discount_amount"),
        store_money(a["subtotal"]).alias("subtotal"), store_money(a["total"]).alias("total"),
        "product_name", "product_sku", "product_barcode")


def priced_sales(lines: DataFrame, headers: DataFrame, products: DataFrame) -> DataFrame:
    """I1 + H16 + H17: sale totals from the **unrounded** line amounts,
    grand = total + tax - discount, each rounded once when stored; cash +
    completed is paid. One aggregate per request after a partial aggregate."""
    known = lines.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    a = line_amounts("unit_price", "quantity", "tax_rate", "discount_percent")
    sums = known.groupBy("request_id").agg(
        F.sum(a["subtotal"]).alias("_sub"), F.sum(a["tax_amount"]).alias("_tax"),
        F.sum(a["discount_amount"]).alias("_disc"), F.count(F.lit(1)).alias("line_count"))
    h = headers.join(sums, "request_id", "left")
    zero = F.lit(0).cast("decimal(36,20)")
    sub = F.coalesce(F.col("_sub").cast("decimal(36,20)"), zero)
    tax = F.coalesce(F.col("_tax").cast("decimal(36,20)"), zero)
    disc = F.coalesce(F.col("_disc").cast("decimal(36,20)"), zero)
    method = F.coalesce(F.col("payment_method"), F.lit("cash")) if "payment_method" in headers.columns \
        else F.lit("cash")
    status = F.coalesce(F.col("status"), F.lit("completed")) if "status" in headers.columns \
        else F.lit("completed")
    requested = F.coalesce(F.col("payment_status"), F.lit("pending")) if "payment_status" in headers.columns \
        else F.lit("pending")
    return h.select(
        "request_id",
        store_money(sub).alias("total_amount"), store_money(tax).alias("tax_amount"),
        store_money(disc).alias("discount_amount"), store_money(sub + tax - disc).alias("grand_total"),
        method.alias("payment_method"), status.alias("status"),
        auto_payment_status(method, status, requested).alias("payment_status"),
        F.coalesce(F.col("line_count"), F.lit(0)).cast("bigint").alias("line_count"))


# ---------------------------------------------------------------- I2

def sale_numbers(new_sales: DataFrame, existing_sales: DataFrame, now: "_dt.datetime | None" = None) -> DataFrame:
    """``SAL-YYYYMMDD-NNN`` for each new sale, numbered per calendar day
    of ``sale_date`` in (sale_date, request_id) order after the largest
    existing number of that day. The reference takes the string-largest
    number, which sticks after 999; the numeric largest is used here.

    Numbering within a day is a skew-safe running count, so a day holding a
    third of all new sales is still spread over many tasks. A sale without a
    date counts as made ``now``; without ``now`` it gets no number (NULL).
    """
    seq_existing = (existing_sales
                    .select("sale_number", F.substring("sale_number", 5, 8).alias("day_key"),
                            sale_number_seq("sale_number").alias("seq"))
                    .where(F.col("sale_number").startswith("SAL-") & F.col("seq").isNotNull())
                    .groupBy("day_key").agg(F.max("seq").alias("last_seq")))
    if now is not None:
        new_sales = new_sales.withColumn("sale_date", F.coalesce("sale_date", ts_lit(now)))
    s = new_sales.select("request_id", "sale_date",
                         F.date_format(day_of("sale_date"), "yyyyMMdd").alias("day_key"))
    undated = s.where("sale_date is null").select(
        "request_id", "sale_date", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("sale_number"))
    numbered = running_totals(s.where("sale_date is not null"), ["day_key"], ["sale_date", "request_id"], {"rank": None})
    j = numbered.join(seq_existing, "day_key", "left")
    seq = F.coalesce(F.col("last_seq"), F.lit(0)) + F.col("rank")
    return j.select("request_id", "sale_date", seq.cast("bigint").alias("seq"),
                    sale_number(day_of("sale_date"), seq).alias("sale_number")).unionByName(undated)


# ---------------------------------------------------------------- I3

def stock_check(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per requested line, whether its product exists and has the
    quantity in stock now (the pre-check, before any posting). Inactive
    products may be sold."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("_name"),
                        F.col("current_stock").alias("_stock"), F.lit(True).alias("_known"))
    j = lines.join(p, "product_id", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    ok = known & (F.col("quantity") <= F.col("_stock"))
    msg = (F.when(~known, F.format_string(MSG_NOT_FOUND, F.col("product_id")))
           .when(~ok, F.format_string(MSG_INSUFFICIENT, F.col("_name"), F.col("_stock"))))
    return j.select("request_id", "product_id", "quantity", ok.alias("ok"), msg.alias("message"))


# ---------------------------------------------------------------- I4

def decide_sales(lines: DataFrame, headers: DataFrame, products: DataFrame,
                 screening_rounds: int = 3, chunk_sales: int = 50000) -> DataFrame:
    """I4's decision table (request_id, accepted, message), stored in the shared folder.

    Sales are posted all-or-nothing in arrival order (sale_date, then request_id; null dates first). A refused sale
    takes nothing. Same-product lines of a sale are summed, which equals the line-by-line decrement. Refused before any
    stock is looked at: a sale without lines, with a line whose quantity is NULL or not above 0, with a line
    without a product, or of an unknown product. See :mod:`stockline.operators.settlement`; its two numbers
    (rounds of bounds before components are looked for, sales of a component settled at a time) do not change
    the result."""
    return _decided(lines, headers, products, screening_rounds, chunk_sales)[0]


def _decided(lines: DataFrame, headers: DataFrame, products: DataFrame,
             screening_rounds: int = 3, chunk_sales: int = 50000) -> tuple[DataFrame, DataFrame]:
    """:func:`decide_sales`'s table, and the stored lines (one row per sale and product) it was made from."""
    order = headers.select("request_id", F.col("sale_date").alias("_ts"))
    l = cut_lineage(collapsed_lines(lines, headers, products))
    seen = l.groupBy("request_id").agg(
        F.bool_or("bad").alias("bad"), F.bool_or(F.col("product_id").isNull()).alias("unnamed"),
        F.min(F.when(F.col("stock").isNull(), F.col("product_id"))).alias("missing"), F.lit(True).alias("has_lines"))
    fault = (F.when(F.col("has_lines").isNull(), F.lit(MSG_NO_ITEMS)).when(F.col("bad"), F.lit(MSG_BAD_QUANTITY))
             .when(F.col("unnamed"), F.lit(MSG_NO_PRODUCT))
             .when(F.col("missing").isNotNull(), F.format_string(MSG_NOT_FOUND, F.col("missing"))))
    checked = cut_lineage(order.join(seen, "request_id", "left").select("request_id", fault.alias("fault")))
    valid = l.join(checked.where("fault is null").select("request_id"), "request_id", "left_semi")
    asked = valid.groupBy("product_id").agg(F.sum("qty").alias("asked"), F.max("stock").alias("_stock")).where("asked > _stock")
    scarce = cut_lineage(valid.join(asked.select("product_id"), "product_id", "left_semi")
                         .select("request_id", "product_id", "qty", "stock", "pname", "_ts"))
    refused = decide(scarce.drop("pname"), screening_rounds, chunk_sales)
    # A refused sale names its first product (by id) that cannot fit with the stock left by the sales accepted before it.
    told = scarce.join(refused.withColumn("out", F.lit(True)), "request_id", "left").withColumn(
        "acc_q", F.when(F.col("out"), 0).otherwise(F.col("qty")))
    low = running_totals(told, ["product_id"], ["_ts", "request_id"], {"low": "acc_q"}, inclusive=False)
    short = (low.where(F.col("out") & (F.col("low") + F.col("qty") > F.col("stock"))).groupBy("request_id")
             .agg(F.min_by(F.struct("pname", (F.col("stock") - F.col("low")).alias("avail")), F.col("product_id")).alias("s")))
    why = F.coalesce(F.col("fault"), F.when(F.col("s").isNotNull(), F.format_string(MSG_INSUFFICIENT, F.col("s.pname"), F.col("s.avail"))))
    return cut_lineage(checked.join(short, "request_id", "left").select(
        "request_id", why.isNull().alias("accepted"), F.coalesce(why, F.lit(MSG_CREATED)).alias("message"))), l


def _less_stock(products: DataFrame, collapsed: DataFrame, accepted: DataFrame, now) -> DataFrame:
    """Products without the units of accepted sales (partial aggregate, then join). ``collapsed`` holds one quantity per
    sale and product, in as many rows as the sale's header and the product have."""
    units = collapsed.join(accepted, "request_id", "left_semi").groupBy("request_id", "product_id").agg(F.max("qty").alias("qty"))
    taken = units.groupBy("product_id").agg(F.sum("qty").alias("_taken"))
    new_products = (products.join(taken, products.id == taken.product_id, "left")
                    .withColumn("current_stock", (F.col("current_stock")
                                                  - F.coalesce(F.col("_taken"), F.lit(0))).cast("int")))
    return stamp_updated(new_products, F.col("_taken").isNotNull(), now).drop("product_id", "_taken")


def post_sales(lines: DataFrame, headers: DataFrame, products: DataFrame,
               screening_rounds: int = 3, chunk_sales: int = 50000,
               now: "_dt.datetime | None" = None) -> tuple[DataFrame, DataFrame]:
    """I4: post a batch of sales against stock, as :func:`decide_sales` decides. Every status lowers stock, drafts
    included. Returns ``(new products, result frame)``. With ``now``, products whose stock
    changes get it as ``updated_at``."""
    result, collapsed = _decided(lines, headers, products, screening_rounds, chunk_sales)
    return _less_stock(products, collapsed, result.where("accepted").select("request_id"), now), result


@dataclass
class Posted:
    """What posting a batch of sales makes: new products, new sale and line rows, one result row per request. The lines
    are numbered (a job of its own) when they are first asked for."""
    products: DataFrame
    sales: DataFrame
    results: DataFrame
    number_items: Callable[[], DataFrame]

    @cached_property
    def sale_items(self) -> DataFrame:
        return self.number_items()


def post_sales_tables(lines: DataFrame, headers: DataFrame, products: DataFrame, sales: DataFrame,
                      now: "_dt.datetime | None" = None) -> Posted:
    """I4 with its rows: all four results come from one stored decision table.

    Accepted sales become full rows of ``sales``: ids follow the largest existing id in arrival order, numbers are
    I2's (a refused sale uses none), totals I1's, payment status H17's; other columns are the header's. A header without
    a date is made ``now``, for its place in the day; in arrival order it comes first. Lines become rows
    of ``sale_items`` with the amounts and the product's name, sku and barcode at sale time; a line's id is made of its sale's
    id and its place there. ``created_at`` is ``now``.
    Requests of either table that are refused add no row."""
    results, collapsed = _decided(lines, headers, products)
    accepted = results.where("accepted").select("request_id")
    heads = headers.join(accepted, "request_id", "left_semi")
    taken = lines.join(accepted, "request_id", "left_semi")
    top = sales.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = running_totals(heads.select("request_id", "sale_date", F.lit(0).alias("_all")), ["_all"], ["sale_date", "request_id"],
                            {"place": None})
    ids = cut_lineage(placed.select("request_id", (F.col("place") + top.scalar()).alias("id")))
    numbers = sale_numbers(heads.select("request_id", "sale_date"), sales, now).select(
        "request_id", "sale_number", F.col("sale_date").alias("_made"))
    totals = priced_sales(taken, heads, products).drop("line_count")
    made = F.lit(None).cast("timestamp_ntz") if now is None else ts_lit(now)
    rows = (heads.drop(*[c for c in totals.columns if c != "request_id"], "sale_number", "id", "created_at", "updated_at")
            .join(ids, "request_id").join(numbers, "request_id").join(totals, "request_id")
            .withColumns({"sale_date": F.col("_made"), "created_at": made}))

    def number_items() -> DataFrame:
        priced = priced_lines(taken, products).join(ids.select("request_id", F.col("id").alias("sale_id")), "request_id")
        items = running_totals(priced, ["sale_id"], ["product_id", "quantity", "unit_price", "tax_rate", "discount_percent"], {"place": None}).withColumns(
            {"id": F.col("sale_id") * LINES_PER_SALE + F.col("place"), "created_at": made})
        return conform(items, SALE_ITEMS)

    return Posted(_less_stock(products, collapsed, accepted, now), conform(rows, SALES), results, number_items)


# ---------------------------------------------------------------- I5

def cancel_sales(sales: DataFrame, sale_items: DataFrame, products: DataFrame,
                 requests: DataFrame, now: "_dt.datetime | None" = None
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cancel the requested sales (``request_id`` = sale id). Not if
    missing or already cancelled; otherwise every line goes back to stock,
    status becomes cancelled and payment status refunded (if paid) or
    pending. Drafts can be cancelled too. With ``now``, changed rows get it as ``updated_at``.
    Returns (sales, products, result)."""
    req = requests.select(F.col("request_id").alias("id")).distinct()
    cur = sales.select("id", F.col("status").alias("_old"))
    r = req.join(cur, "id", "left")
    ok = F.col("_old").isNotNull() & (F.col("_old") != "cancelled")
    result = r.select(F.col("id").alias("request_id"), ok.alias("accepted"),
                      F.when(F.col("_old").isNull(), F.lit(MSG_SALE_NOT_FOUND))
                       .when(F.col("_old") == "cancelled", F.lit(MSG_ALREADY_CANCELLED))
                       .otherwise(F.lit(MSG_CANCELLED)).alias("message"))
    go = r.where(ok).select(F.col("id").alias("_cid"))
    new_sales = (sales.join(go, sales.id == go._cid, "left")
                 .withColumn("payment_status", F.when(F.col("_cid").isNotNull(),
                                                      cancel_payment_status("payment_status"))
                             .otherwise(F.col("payment_status")))
                 .withColumn("status", F.when(F.col("_cid").isNotNull(), F.lit("cancelled"))
                             .otherwise(F.col("status"))))
    new_sales = stamp_updated(new_sales, F.col("_cid").isNotNull(), now).drop("_cid")
    back = (sale_items.join(go.select(F.col("_cid").alias("sale_id")), "sale_id", "left_semi")
            .groupBy("product_id").agg(F.sum("quantity").alias("_back")))
    new_products = (products.join(back, products.id == back.product_id, "left")
                    .withColumn("current_stock", (F.col("current_stock")
                                                  + F.coalesce(F.col("_back"), F.lit(0))).cast("int")))
    new_products = stamp_updated(new_products, F.col("_back").isNotNull(), now).drop("product_id", "_back")
    return new_sales, new_products, result


# ---------------------------------------------------------------- I6

PATCHABLE_SALE_FIELDS = ("customer_name", "customer_email", "customer_phone", "payment_method",
                         "payment_status", "payment_reference", "status", "shipping_address",
                         "shipping_city", "shipping_state", "shipping_country", "shipping_pincode",
                         "notes")


def fold_patches(patches: DataFrame) -> DataFrame:
    """One row per ``request_id`` (the key of the patched row). Of several patches of a key, each field
    takes the value of the last one that gives it, by the optional ``seq`` column; without ``seq`` (or on
    equal ones) the largest given value, so the result does not depend on row order."""
    order = F.col("seq") if "seq" in patches.columns else F.lit(0)
    flags = [c for c in patches.columns if c.startswith("set_")]
    fields = [c for c in patches.columns if c not in ("request_id", "seq", *flags)]
    given = {f: F.coalesce(F.col(f"set_{f}"), F.lit(False)) if f"set_{f}" in flags else F.lit(True) for f in fields}
    last = [F.max(F.when(given[f], F.struct(order.alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return patches.groupBy("request_id").agg(*last, *[F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags])


def apply_patch(table: DataFrame, patches: DataFrame, fields: tuple, key: str = "id",
                allowed: "F.Column | None" = None, now: "_dt.datetime | None" = None) -> DataFrame:
    """Patch semantics: a field is changed only when the patch row gives it,
    marked by the boolean ``set_<field>`` column ("given as NULL" clears,
    "not given" keeps). ``allowed`` is an extra condition on the row as it was
    before the patch. Several patches of a key are folded first. With ``now``, patched rows get it as
    ``updated_at``."""
    patches = fold_patches(patches)
    pcols = [c for c in patches.columns if c != "request_id"]
    p = patches.select(F.col("request_id").alias("_pid"), *[F.col(c).alias(f"_p_{c}") for c in pcols])
    j = table.join(p, table[key] == p._pid, "left")
    hit = F.col("_pid").isNotNull()
    if allowed is not None:
        hit = hit & allowed
    patched = {f for f in fields if f"set_{f}" in pcols}
    j = stamp_updated(j, hit, now)
    return j.select(*[
        F.when(hit & F.coalesce(F.col(f"_p_set_{f}"), F.lit(False)),
               F.col(f"_p_{f}").cast(table.schema[f].dataType)).otherwise(F.col(f)).alias(f)
        if f in patched else F.col(f) for f in table.columns])


def patch_sales(sales: DataFrame, patches: DataFrame, now: "_dt.datetime | None" = None) -> tuple[DataFrame, DataFrame]:
    """Patch header fields of draft sales; completed / cancelled sales are
    refused. Changing status to completed has no stock or payment effect."""
    cur = sales.select(F.col("id").alias("request_id"), F.col("status").alias("_old"))
    r = patches.select("request_id").distinct().join(cur, "request_id", "left")
    ok = F.col("_old").isNotNull() & ~F.col("_old").isin("completed", "cancelled")
    result = r.select("request_id", ok.alias("accepted"),
                      F.when(F.col("_old").isNull(), F.lit(MSG_SALE_NOT_FOUND))
                       .when(~ok, F.format_string(MSG_CANNOT_UPDATE, F.col("_old")))
                       .otherwise(F.lit(MSG_UPDATED)).alias("message"))
    allowed = ~F.col("status").isin("completed", "cancelled")
    new_sales = apply_patch(sales, patches, PATCHABLE_SALE_FIELDS, "id", allowed, now)
    return new_sales, result


# ---------------------------------------------------------------- I7

def delete_drafts(sales: DataFrame, sale_items: DataFrame, requests: DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the requested sales that are drafts, and their lines
    (cascade). Stock is **not** restored (faithful). Returns (sales,
    sale_items, result)."""
    req = requests.select(F.col("request_id").alias("id")).distinct()
    r = req.join(sales.select("id", "status"), "id", "left")
    ok = F.coalesce(F.col("status") == "draft", F.lit(False))
    result = r.select(F.col("id").alias("request_id"), ok.alias("accepted"),
                      F.when(ok, F.lit("Sale deleted successfully"))
                       .otherwise(F.lit("Sale not found or not a draft")).alias("message"))
    gone = r.where(ok).select("id")
    new_sales = sales.join(gone, "id", "left_anti")
    new_items = sale_items.join(gone.select(F.col("id").alias("sale_id")), "sale_id", "left_anti")
    return new_sales, new_items, result

