"""Registered sink queries (A3-A5, A8): write to the shared scratch folder,
read the written files back with an explicit schema, and return them, so
the gate checks the round trip."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from stockline.operators import sales as sal
from stockline.plans.registry import AS_OF, FULL_END, FULL_START, present, register, shop
from stockline.session import scratch_path
from stockline.sources import sinks

NOW = _dt.datetime(2001, 8, 1, 12, 0, 0)


@register("export_csv")
def export_csv(spark, sf):
    """A4: the sales report by day written as CSV and read back."""
    sh = shop(spark, sf)
    data = present(sal.sales_by_period(sh.sales, sh.sale_items, FULL_START, FULL_END, "day"))
    path = sinks.write_csv(data, scratch_path(spark, "export_csv"))
    return spark.read.schema(data.schema).option("header", True).csv(path)


@register("sink_json")
def sink_json(spark, sf):
    """A3: the sales report by product written as JSON lines and read back."""
    sh = shop(spark, sf)
    data = sal.sales_by_product(sh.sales, sh.sale_items, FULL_START, FULL_END)
    path = sinks.write_json(data, scratch_path(spark, "sink_json"))
    return spark.read.schema(data.schema).json(path)


@register("export_pair")
def export_pair(spark, sf):
    """A5: inventory report + summary written as a parquet pair; the summary
    is read back."""
    sh = shop(spark, sf)
    data, summary = sinks.report_for(sh, "inventory", AS_OF)
    paths = sinks.export_pair(data, summary, scratch_path(spark, "export_pair"), "parquet")
    return spark.read.parquet(paths["summary"])


@register("export_report")
def export_report(spark, sf):
    """``sales`` export (last 30 days by day) as CSV; the data part is
    read back."""
    sh = shop(spark, sf)
    data, _ = sinks.report_for(sh, "sales", AS_OF)
    schema = present(data).schema
    paths = sinks.export_report(sh, "sales", scratch_path(spark, "export_report"), AS_OF, "csv", now=NOW)
    return spark.read.schema(schema).option("header", True).csv(paths["data"])


@register("export_pair_parts")
def export_pair_parts(spark, sf):
    """A5: both parts of the inventory export, read back as one tagged table."""
    sh = shop(spark, sf)
    data, summary = (present(d) for d in sinks.report_for(sh, "inventory", AS_OF))
    path = scratch_path(spark, "export_pair_parts")
    sinks.export_pair(data, summary, path, "parquet")
    return sinks.read_pair(spark, path, data.schema, summary.schema)


@register("export_report_parts")
def export_report_parts(spark, sf):
    """Both parts of the ``sales`` export as CSV, read back as one tagged table."""
    sh = shop(spark, sf)
    data, summary = (present(d) for d in sinks.report_for(sh, "sales", AS_OF))
    paths = sinks.export_report(sh, "sales", scratch_path(spark, "export_report_parts"), AS_OF, "csv", now=NOW)
    return sinks.read_pair(spark, paths["data"].rpartition("/")[0], data.schema, summary.schema, "csv")


@register("payment_method_map")
def payment_method_map(spark, sf):
    """D7 in its map form, flattened back to rows for the comparison."""
    m = sal.payment_method_map(shop(spark, sf).sales, FULL_START, FULL_END)
    return m.select(F.explode("payment_methods").alias("payment_method", "sales_count"))
