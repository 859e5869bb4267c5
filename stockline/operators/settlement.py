"""I4's decisions: which sales of a batch are accepted, all-or-nothing and in arrival order.

Only products that are asked for beyond their stock can refuse a sale; lines of all other products leave at once.
What is left is decided in rounds, all on tables cut from their lineage:

- Bounds. Per product in arrival order, ``low`` adds up the earlier accepted units and ``high`` also the earlier
  open ones (running sums over ranges, so a hot product is many tasks). A sale is accepted if all its lines fit
  under ``high`` and refused if one fails under ``low``; both are final.
- Conflict components. Open sales that share a product which is still scarce form a graph. Its components do not
  touch each other: the first ``slice_sales`` sales of each are settled in arrival order, as many components to a
  task as come to it. A component of more sales (a hot product) meets the bounds again with its first ones settled,
  which decides most of the rest; no task ever goes through all open sales.

The rounds end when no sale is open; each settles at least the first sales of every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.plans.components import component_marks
from stockline.plans.ordered import running_totals
from stockline.session import cut_lineage

MSG_BAD_QUANTITY = "Quantity must be greater than 0"     # the request schema's rule
MSG_NO_PRODUCT = "Product ID missing"                    # our own wording (schema rule)


def collapsed_lines(lines: DataFrame, headers: DataFrame, products: DataFrame) -> DataFrame:
    """(request_id, product_id, qty, bad, _ts, stock, pname): one row per sale and product; ``bad`` marks a missing or
    non-positive quantity."""
    order = headers.select("request_id", F.col("sale_date").alias("_ts"))
    bad = F.coalesce(F.col("quantity") <= 0, F.lit(True))
    summed = lines.groupBy("request_id", "product_id").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("qty"), F.bool_or(bad).alias("bad"))
    p = products.select(F.col("id").alias("product_id"), F.col("current_stock").cast("bigint").alias("stock"),
                        F.col("name").alias("pname"))
    return summed.join(order, "request_id").join(p, "product_id", "left")


def decide(scarce: DataFrame, rounds: int, slice_sales: int) -> DataFrame:
    """The refused request_ids of ``scarce`` lines (request_id, product_id, qty, stock, _ts), one row per sale and product
    with a known product; a sale stands here with all its scarce lines. Rounds read ``scarce`` again: cut it before."""
    work = scarce.withColumn("state", F.lit("open"))
    refused: list[DataFrame] = []
    while True:
        for _ in range(max(1, rounds)):
            work = _by_bounds(work, refused)
            if work.where("state = 'open'").limit(1).count() == 0:
                break
        else:
            work = _by_components(work, refused, slice_sales)
            if work.where("state = 'open'").limit(1).count():
                continue
        break
    out = refused[0]
    for more in refused[1:]:
        out = out.union(more)
    return out


def _sums(work: DataFrame) -> DataFrame:
    held = work.withColumns({"acc_q": F.when(F.col("state") == "accepted", F.col("qty")).otherwise(0), "pend_q": F.col("qty")})
    return running_totals(held, ["product_id"], ["_ts", "request_id"], {"low": "acc_q", "high": "pend_q"},
                          inclusive=False).drop("acc_q", "pend_q")


def _with_verdicts(work: DataFrame, verdicts: DataFrame, refused: list[DataFrame]) -> DataFrame:
    """Open sales take their verdict (request_id, accepted); refused ones leave, and with them the products that no
    open line can miss any more."""
    refused.append(verdicts.where("not accepted").select("request_id"))
    done = work.join(verdicts, "request_id", "left").where(F.coalesce("accepted", F.lit(True)))
    done = done.withColumn("state", F.when(F.col("accepted"), "accepted").otherwise(F.col("state"))).drop("accepted")
    tight = done.groupBy("product_id").agg(
        (F.sum("qty") > F.max("stock")).alias("scarce"), F.bool_or(F.col("state") == "open").alias("has_open")).where("scarce and has_open")
    return cut_lineage(done.join(tight.select("product_id"), "product_id", "left_semi"))


def _by_bounds(work: DataFrame, refused: list[DataFrame]) -> DataFrame:
    verdicts = _sums(work).where("state = 'open'").groupBy("request_id").agg(
        F.bool_and(F.col("high") + F.col("qty") <= F.col("stock")).alias("fits"),
        F.bool_or(F.col("low") + F.col("qty") > F.col("stock")).alias("fails")).where("fits or fails").select(
        "request_id", F.col("fits").alias("accepted"))
    return _with_verdicts(work, cut_lineage(verdicts), refused)


def _by_components(work: DataFrame, refused: list[DataFrame], slice_sales: int) -> DataFrame:
    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Replays the rule over lines sorted by component, sale and product; holds one sale's lines and the units taken
        so far in its component."""
        component, sale, used, lines = None, None, {}, []
        out: list[tuple[int, bool]] = []

        def close():
            if sale is not None:
                fits = all(low + used.get(p, 0) + q <= stock for p, q, stock, low in lines)
                if fits:
                    for p, q, _, _ in lines:
                        used[p] = used.get(p, 0) + q
                out.append((sale, fits))

        for batch in batches:
            for c, s, p, q, stock, low in zip(*[batch[k].tolist() for k in ("component", "request_id", "product_id", "qty", "stock", "low")]):
                if s != sale or c != component:
                    close()
                    if c != component:
                        component, used = c, {}
                    sale, lines = s, []
                lines.append((p, q, stock, low))
            if out:
                yield pd.DataFrame(out, columns=["request_id", "accepted"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "accepted"])

    lines = cut_lineage(_sums(work).where("state = 'open'").drop("high", "state"))
    # The products of a sale are linked through its smallest one, which then tells the sale's component.
    sales = cut_lineage(lines.groupBy("request_id", "_ts").agg(F.min("product_id").alias("least")))
    links = lines.join(sales.select("request_id", "least"), "request_id")
    marks = component_marks(links.select(F.col("least").alias("a"), F.col("product_id").alias("b")))
    sales = sales.join(marks.withColumnRenamed("node", "least"), "least")
    first = running_totals(sales, ["component"], ["_ts", "request_id"], {"place": None}).where(F.col("place") <= slice_sales)
    settled = (lines.join(first.select("request_id", "component"), "request_id").repartition("component")
               .sortWithinPartitions("component", F.col("_ts").asc_nulls_first(), "request_id", "product_id")
               .select("component", "request_id", "product_id", "qty", "stock", "low")
               .mapInPandas(settle, "request_id long, accepted boolean"))
    return _with_verdicts(work, cut_lineage(settled), refused)
