"""Catalogue and stock changes as snapshot jobs: I8-I13.

Each operator takes the current table(s) and a request frame and returns new
table(s) plus a result frame ``(request_id, accepted, message)``. Checks that
the reference makes one row at a time (key exists, key is new, result stays
non-negative) become anti / semi / left joins over the whole batch; new ids
come from a skew-safe running count (:mod:`stockline.plans.ordered`), never
from a driver-side counter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline import schema as S
from stockline.functions.exprs import input_price, margin_percent, stamp_updated, ts_lit
from stockline.operators.posting import apply_patch, fold_patches
from stockline.plans.components import component_marks
from stockline.plans.fold import conditional_fold
from stockline.plans.ordered import running_totals
from stockline.session import cut_lineage

# Fixed messages (as the reference words them; "ok" is ours).
MSG_SKU_EXISTS = "Product with this SKU already exists"
MSG_BARCODE_EXISTS = "Product with this barcode already exists"
MSG_CATEGORY_NOT_FOUND = "Category not found"
MSG_SUPPLIER_NOT_FOUND = "Supplier not found"
MSG_PRODUCT_NOT_FOUND = "Product not found"
MSG_STOCK_REFUSED = "Product not found or insufficient stock"
MSG_CATEGORY_NAME_EXISTS = "Category with this name already exists"
MSG_SUPPLIER_NAME_EXISTS = "Supplier with this name already exists"
MSG_SUPPLIER_EMAIL_EXISTS = "Supplier with this email already exists"
MSG_OK = "ok"

PRODUCT_DEFAULTS = {"min_stock_level": 10, "max_stock_level": 100, "unit_of_measure": "pcs",
                    "is_active": True, "is_taxable": True, "tax_rate": 18.0, "current_stock": 0}


def _rivals(requests: DataFrame, keys: list[str], slice_requests: int = 50_000) -> DataFrame:
    """The requests (request_id, *keys) that lose a key to an earlier one: (request_id, _lost), the number in
    ``keys`` of the first key that an accepted request with a smaller id holds. Pass only requests that no other
    check refuses: a refused request takes no key from a later one. NULL keys clash with nothing.

    A round accepts the open requests that come first for all their keys and refuses those that share a
    key with one of them; without rivals the first round decides all. Chains of requests, each in the way of
    the next, would take a round a link: what two rounds leave is cut into components of requests that share keys, and the
    first ``slice_requests`` of each are replayed in order, many components a task. A longer chain goes round again, so
    rounds grow with the logarithm of a chain (to find its component) and with its number of slices."""
    open_ = cut_lineage(requests.select("request_id", *keys))
    rounds: list[DataFrame] = []
    while True:
        won = _replayed(open_, keys, slice_requests) if len(rounds) % 3 == 2 else _first_of_all(open_, keys)
        rounds.append(won)
        left = open_.join(won.select("request_id"), "request_id", "left_anti")
        for k in keys:
            left = left.join(won.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        open_ = cut_lineage(left)
        if open_.isEmpty():
            break
    accepted = rounds[0]
    for won in rounds[1:]:
        accepted = accepted.unionByName(won)
    out = requests.select("request_id", *keys)
    for n, k in enumerate(keys):
        held = accepted.where(F.col(k).isNotNull()).select(F.col(k), F.col("request_id").alias(f"_by_{n}"))
        out = out.join(held, k, "left")
    lost = F.coalesce(*[F.when(F.col(f"_by_{n}") < F.col("request_id"), F.lit(n)) for n in range(len(keys))])
    return out.select("request_id", lost.alias("_lost")).where("_lost is not null")


def _first_of_all(open_: DataFrame, keys: list[str]) -> DataFrame:
    """Open requests that are the first for every key they have."""
    firsts, wins = open_, F.lit(True)
    for k in keys:
        first = open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("request_id").alias(f"_first_{k}"))
        firsts = firsts.join(first, k, "left")
        wins = wins & F.coalesce(F.col(f"_first_{k}") == F.col("request_id"), F.lit(True))
    return cut_lineage(firsts.where(wins).select("request_id", *keys))


def _replayed(open_: DataFrame, keys: list[str], slice_requests: int) -> DataFrame:
    """The accepted among the first ``slice_requests`` open requests of every component, in request order."""
    def replay(batches):
        import pandas as pd
        component, taken = None, set()
        for batch in batches:
            kept = []
            for c, r, *held in batch[["component", "request_id", *keys]].itertuples(index=False, name=None):
                if c != component:
                    component, taken = c, set()
                held = {(n, v) for n, v in enumerate(held) if v is not None and v == v}
                if not held & taken:
                    taken |= held
                    kept.append((r, *[dict(held).get(n) for n in range(len(keys))]))
            yield pd.DataFrame(kept, columns=["request_id", *keys])

    # Keys are nodes, by hash: two keys of equal hash only put their requests into one component.
    nodes = [F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(n), k)) for n, k in enumerate(keys)]
    edges = open_.select("request_id", *keys, F.coalesce(*nodes).alias("a"), F.coalesce(*reversed(nodes)).alias("b"))
    marks = component_marks(edges.select("a", "b")).withColumnRenamed("node", "a")
    placed = running_totals(edges.join(marks, "a"), ["component"], ["request_id"], {"_place": None}).where(F.col("_place") <= slice_requests)
    rows = placed.select("component", "request_id", *keys).repartition("component").sortWithinPartitions("component", "request_id")
    return cut_lineage(rows.mapInPandas(replay, open_.select("request_id", *keys).schema))


def _assign_ids(accepted: DataFrame, existing: DataFrame) -> DataFrame:
    """New ids after the largest existing id, in request order (one running
    count over the batch, split across partitions)."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ranked = running_totals(accepted.withColumn("_all", F.lit(0)), ["_all"], ["request_id"], {"_rank": None})
    return ranked.withColumn("id", (top.select("_top").scalar() + F.col("_rank")).cast("bigint")) \
                 .drop("_all", "_rank")


# ---------------------------------------------------------------- I8

def add_products(products: DataFrame, categories: DataFrame, suppliers: DataFrame,
                 requests: DataFrame, now: _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """I8: add products. The sku (and barcode, when given) must be new, also
    within the batch (the first accepted request wins); category / supplier must
    exist when given (0 means none). Margin by H1; ``last_restocked = now``
    when the opening stock is positive. Returns (products, result)."""
    r = requests
    for f in S.PRODUCTS.fields:          # absent optional fields are NULL
        if f.name not in r.columns and f.name != "id":
            r = r.withColumn(f.name, F.lit(None).cast(f.dataType))
    for c, v in PRODUCT_DEFAULTS.items():
        r = r.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in r.columns else r.withColumn(c, F.lit(v))
    for c in ("cost_price", "selling_price"):   # H21; a missing price is 0.00
        r = r.withColumn(c, F.coalesce(input_price(c), F.lit(0).cast(S.MONEY)))
    sku_taken = products.select(F.col("sku").alias("_sku_old"))
    bc_taken = products.where(F.col("barcode").isNotNull()).select(F.col("barcode").alias("_bc_old"))
    j = (r.join(sku_taken, r.sku == sku_taken._sku_old, "left")
         .join(bc_taken, r.barcode == bc_taken._bc_old, "left")
         .join(categories.select(F.col("id").alias("_cat")), F.col("category_id") == F.col("_cat"), "left")
         .join(suppliers.select(F.col("id").alias("_sup")), F.col("supplier_id") == F.col("_sup"), "left"))
    sku_dup = F.col("_sku_old").isNotNull()
    bc_dup = F.col("_bc_old").isNotNull()
    cat_bad = (F.coalesce(F.col("category_id"), F.lit(0)) != 0) & F.col("_cat").isNull()
    sup_bad = (F.coalesce(F.col("supplier_id"), F.lit(0)) != 0) & F.col("_sup").isNull()
    message = (F.when(sku_dup, F.lit(MSG_SKU_EXISTS)).when(bc_dup, F.lit(MSG_BARCODE_EXISTS))
               .when(cat_bad, F.lit(MSG_CATEGORY_NOT_FOUND)).when(sup_bad, F.lit(MSG_SUPPLIER_NOT_FOUND)))
    j = j.withColumn("message", message)
    lost = _rivals(j.where(F.col("message").isNull()), ["sku", "barcode"])
    j = j.join(lost, "request_id", "left").withColumn("message", F.coalesce(
        "message", F.when(F.col("_lost") == 0, F.lit(MSG_SKU_EXISTS)).when(F.col("_lost") == 1, F.lit(MSG_BARCODE_EXISTS))))
    result = j.select("request_id", F.col("message").isNull().alias("accepted"),
                      F.coalesce(F.col("message"), F.lit(MSG_OK)).alias("message"))
    ok = j.where(F.col("message").isNull())
    ok = (ok.withColumn("margin", margin_percent(F.col("selling_price").cast(S.MONEY),
                                                F.col("cost_price").cast(S.MONEY)))
            .withColumn("last_restocked", F.when(F.col("current_stock") > 0, ts_lit(now)))
            .withColumn("created_at", ts_lit(now)))
    new_rows = S.conform(_assign_ids(ok, products), S.PRODUCTS)
    return S.conform(products, S.PRODUCTS).unionByName(new_rows), result


# ---------------------------------------------------------------- I9

PATCHABLE_PRODUCT_FIELDS = ("sku", "name", "description", "category_id", "supplier_id", "cost_price",
                            "selling_price", "current_stock", "min_stock_level", "max_stock_level",
                            "unit_of_measure", "brand", "model", "weight", "dimensions", "barcode",
                            "is_active", "is_taxable", "tax_rate")


def patch_products(products: DataFrame, patches: DataFrame,
                   now: _dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Change only the given fields (``set_<field>`` flags). When a price
    is given, the margin is recomputed from the new prices if cost > 0,
    else the old margin stays."""
    patches = fold_patches(patches)
    ids = products.select(F.col("id").alias("request_id"), F.lit(True).alias("_found"))
    r = patches.select("request_id").distinct().join(ids, "request_id", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    result = r.select("request_id", found.alias("accepted"),
                      F.when(found, F.lit(MSG_OK)).otherwise(F.lit(MSG_PRODUCT_NOT_FOUND)).alias("message"))
    flags = [c for c in ("set_cost_price", "set_selling_price") if c in patches.columns]
    price_given = None
    for c in flags:
        price_given = F.col(c) if price_given is None else (price_given | F.col(c))
    marks = patches.select(F.col("request_id").alias("_mid"),
                           (F.coalesce(price_given, F.lit(False)) if price_given is not None
                            else F.lit(False)).alias("_price_given"))
    for c in ("cost_price", "selling_price"):   # H21
        if c in patches.columns:
            patches = patches.withColumn(c, input_price(c))
    patched = apply_patch(products, patches, PATCHABLE_PRODUCT_FIELDS, "id", now=now)
    patched = patched.join(marks, patched.id == marks._mid, "left")
    new_margin = margin_percent("selling_price", "cost_price")
    patched = patched.withColumn("margin", F.when(
        F.coalesce(F.col("_price_given"), F.lit(False)) & (F.col("cost_price") > 0), new_margin)
        .otherwise(F.col("margin"))).drop("_mid", "_price_given")
    return patched, result


# ---------------------------------------------------------------- I10, I11

def stock_ledger(products: DataFrame, changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every change of stock in order: ``changes`` of known products with ``accepted`` and the ``balance`` after it.

    A change is accepted if the stock left by the accepted ones before it does not fall below 0; changes of a
    product follow each other by the optional ``seq`` column, then ``request_id``. A NULL quantity is refused.
    Changes of unknown products or of none are left out. A product with many changes is many tasks' work
    (:mod:`stockline.plans.fold`)."""
    order = (["seq"] if "seq" in changes.columns else []) + ["request_id"]
    stock = products.select(F.col("id").alias("product_id"), F.col("current_stock").alias("_stock"))
    return conditional_fold(changes.join(stock, "product_id"), "product_id", order, "quantity", "_stock", partitions).drop("_stock")


def _stock_changes(products: DataFrame, changes: DataFrame, now: _dt.datetime):
    """New products, and all changes with ``accepted``. Several changes of a product apply one after the other."""
    ledger = cut_lineage(stock_ledger(products, changes))
    known = products.select(F.col("id").alias("product_id"))
    j = ledger.drop("balance").unionByName(changes.join(known, "product_id", "left_anti").withColumn("accepted", F.lit(False)))
    good = ledger.where("accepted").groupBy(F.col("product_id").alias("_pid")).agg(
        F.sum("quantity").alias("_q"), F.bool_or(F.col("quantity") > 0).alias("_added"))
    new_products = (products.join(good, products.id == good._pid, "left")
                    .withColumn("current_stock", (F.col("current_stock") + F.coalesce(F.col("_q"), F.lit(0)))
                                .cast("int"))
                    .withColumn("last_restocked", F.when(F.col("_added"), ts_lit(now))
                                .otherwise(F.col("last_restocked"))))
    new_products = stamp_updated(new_products, F.col("_q").isNotNull(), now).drop("_pid", "_q", "_added")
    return new_products, j


def adjust_stock(products: DataFrame, changes: DataFrame, now: _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Add / remove ``quantity`` units; refused when the product is
    missing or stock would go below 0; ``last_restocked = now`` when q > 0.
    Changes of one product apply in order, see :func:`stock_ledger`."""
    new_products, j = _stock_changes(products, changes, now)
    result = j.select("request_id", "accepted",
                      F.when(F.col("accepted"), F.lit(MSG_OK)).otherwise(F.lit(MSG_STOCK_REFUSED))
                      .alias("message"))
    return new_products, result


def bulk_stock(products: DataFrame, changes: DataFrame, now: _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The bulk form: one flag per product, true if all its changes were accepted; good changes are applied
    even when others fail."""
    new_products, j = _stock_changes(products, changes, now)
    flags = j.groupBy("product_id").agg(F.bool_and("accepted").alias("success"))
    return new_products, flags


# ---------------------------------------------------------------- I12

def deactivate_products(products: DataFrame, requests: DataFrame,
                        now: _dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Soft delete (``is_active = false``); missing products refused."""
    req = requests.select(F.col("request_id").alias("_rid")).distinct()
    new_products = (products.join(req, products.id == req._rid, "left")
                    .withColumn("is_active", F.when(F.col("_rid").isNotNull(), F.lit(False))
                                .otherwise(F.col("is_active"))))
    new_products = stamp_updated(new_products, F.col("_rid").isNotNull(), now).drop("_rid")
    found = req.join(products.select(F.col("id").alias("_rid"), F.lit(True).alias("_f")), "_rid", "left")
    ok = F.coalesce(F.col("_f"), F.lit(False))
    result = found.select(F.col("_rid").alias("request_id"), ok.alias("accepted"),
                          F.when(ok, F.lit(MSG_OK)).otherwise(F.lit(MSG_PRODUCT_NOT_FOUND)).alias("message"))
    return new_products, result


# ---------------------------------------------------------------- I13

def merge_dimension(dim: DataFrame, products: DataFrame, kind: str, creates: DataFrame | None = None,
                    patches: DataFrame | None = None, deletes: DataFrame | None = None,
                    now: _dt.datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add / patch / delete categories (``kind='category'``) or suppliers
    (``kind='supplier'``). A new name must be unused (and a new supplier's
    email), also by an earlier accepted request; deleting sets the products' link to NULL (``ON DELETE SET
    NULL``). Returns (dimension, products, result)."""
    if kind not in ("category", "supplier"):
        raise ValueError("kind must be 'category' or 'supplier'")
    schema = S.CATEGORIES if kind == "category" else S.SUPPLIERS
    fk = f"{kind}_id"
    not_found = MSG_CATEGORY_NOT_FOUND if kind == "category" else MSG_SUPPLIER_NOT_FOUND
    results = []
    out = S.conform(dim, schema)
    if creates is not None:
        names = out.select(F.col("name").alias("_old_name"))
        keys = ["name", "email"] if kind == "supplier" and "email" in creates.columns else ["name"]
        taken = [F.lit(MSG_CATEGORY_NAME_EXISTS if kind == "category" else MSG_SUPPLIER_NAME_EXISTS),
                 F.lit(MSG_SUPPLIER_EMAIL_EXISTS)]
        c = creates.join(names, creates.name == names._old_name, "left")
        msg = F.when(F.col("_old_name").isNotNull(), taken[0])
        if len(keys) > 1:
            emails = out.where(F.col("email").isNotNull()).select(F.col("email").alias("_old_email"))
            c = c.join(emails, c.email == emails._old_email, "left")
            msg = msg.when(F.col("_old_email").isNotNull(), taken[1])
        c = c.withColumn("message", msg)
        lost = _rivals(c.where(F.col("message").isNull()), keys)
        c = c.join(lost, "request_id", "left").withColumn("message", F.coalesce(
            "message", F.when(F.col("_lost") == 0, taken[0]).when(F.col("_lost") == 1, taken[1])))
        results.append(c.select("request_id", F.col("message").isNull().alias("accepted"),
                                F.coalesce(F.col("message"), F.lit(MSG_OK)).alias("message")))
        good = c.where(F.col("message").isNull())
        if now is not None:
            good = good.withColumn("created_at", ts_lit(now))
        if kind == "supplier":
            good = (good.withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True)) if "is_active"
                                    in good.columns else F.lit(True))
                    .withColumn("rating", F.coalesce(F.col("rating"), F.lit(5)) if "rating" in good.columns
                                else F.lit(5))
                    .withColumn("country", F.coalesce(F.col("country"), F.lit("India")) if "country"
                                in good.columns else F.lit("India")))
        out = out.unionByName(S.conform(_assign_ids(good, out), schema))
    if patches is not None:
        ids = out.select(F.col("id").alias("request_id"), F.lit(True).alias("_f"))
        r = patches.select("request_id").distinct().join(ids, "request_id", "left")
        ok = F.coalesce(F.col("_f"), F.lit(False))
        results.append(r.select("request_id", ok.alias("accepted"),
                                F.when(ok, F.lit(MSG_OK)).otherwise(F.lit(not_found)).alias("message")))
        fields = tuple(f.name for f in schema.fields if f.name != "id")
        out = apply_patch(out, patches, fields, "id", now=now)
    new_products = products
    if deletes is not None:
        d = deletes.select(F.col("request_id").alias("_did")).distinct()
        found = d.join(out.select(F.col("id").alias("_did"), F.lit(True).alias("_f")), "_did", "left")
        ok = F.coalesce(F.col("_f"), F.lit(False))
        results.append(found.select(F.col("_did").alias("request_id"), ok.alias("accepted"),
                                    F.when(ok, F.lit(MSG_OK)).otherwise(F.lit(not_found)).alias("message")))
        out = out.join(d, out.id == d._did, "left_anti")
        new_products = (products.join(d, products[fk] == d._did, "left")
                        .withColumn(fk, F.when(F.col("_did").isNotNull(), F.lit(None).cast("bigint"))
                                    .otherwise(F.col(fk))).drop("_did"))
    result = dim.sparkSession.createDataFrame([], S.RESULT)
    for r in results:
        result = result.unionByName(r)
    return out, new_products, result

