"""Sinks and export: A3-A5, A8, and snapshot writes for the I family.

Every writer is a distributed ``DataFrame.write``: no report is gathered on
the driver. A "file" of the reference becomes a folder of part files; the
Excel workbook becomes a ``data/`` + ``summary/`` pair (the workbook itself,
column widths and drawn charts are presentation and are not built).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockline.operators import inventory as inv
from stockline.operators import sales as sal

FORMATS = ("csv", "json", "parquet")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A3: JSON lines, one object per row."""
    df.write.mode(mode).json(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A4: CSV with a header row and no index column."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    getattr(w, fmt)(path)
    return path


def export_pair(data: DataFrame, summary: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "errorifexists") -> dict[str, str]:
    """A5 (re-aimed): the report's rows and its one-row summary as ``path/data`` and ``path/summary``.

    Both are written beside ``path`` first and appear there together, by one rename of their folder: a reader
    finds both parts or none. ``mode`` is errorifexists or overwrite."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be errorifexists or overwrite")
    spark, path = data.sparkSession, path.rstrip("/")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "errorifexists" and store.exists(target):
        raise FileExistsError(path)
    aside = f"{path}.{uuid.uuid4().hex}"
    write_table(data, f"{aside}/data", fmt)
    write_table(summary, f"{aside}/summary", fmt)
    if mode == "overwrite":
        store.delete(target, True)
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
        raise FileExistsError(path)
    return {"data": f"{path}/data", "summary": f"{path}/summary"}


def read_pair(spark: SparkSession, path: str, data_schema: T.StructType, summary_schema: T.StructType,
              fmt: str = "parquet") -> DataFrame:
    """Both parts of :func:`export_pair` as one table: ``part`` (data or summary) and the columns of both, NULL where a
    part lacks them."""
    parts = []
    for part, schema in (("data", data_schema), ("summary", summary_schema)):
        rows = spark.read.schema(schema).format(fmt).option("header", True).load(f"{path.rstrip('/')}/{part}")
        parts.append(rows.select(F.lit(part).alias("part"), *schema.names))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def write_snapshot(df: DataFrame, path: str, source_paths: list[str] | None = None,
                   fmt: str = "parquet") -> str:
    """Write a new table snapshot (I family). Parquet has no in-place update,
    so a snapshot always goes to a new path, never over an input it reads."""
    for src in source_paths or []:
        if src.rstrip("/") == path.rstrip("/"):
            raise ValueError("a snapshot must not overwrite a table it is computed from")
    return write_table(df, path, fmt, "errorifexists")


def publish_months(new_sales: DataFrame, changed: DataFrame, path: str) -> list[str | None]:
    """I5-I7 on sales stored by month: rewrites only the months that hold changed or deleted sales.

    ``path`` is a parquet table of sales partitioned by ``sale_month``; ``new_sales`` is the new snapshot (with that
    column), ``changed`` the (id) of sales that it changes or leaves out. Rows of the months touched are read and
    written beside the table and replace these months when the job commits (dynamic partition overwrite); all
    other months' files stay as they are. A month that loses its last sale goes. Frames that still read the old
    files of a month are not to be used afterwards. Returns the months touched: one value a month reaches the driver."""
    spark = new_sales.sparkSession
    old = spark.read.schema(new_sales.schema).parquet(path)
    months = [r.sale_month for r in old.join(changed.select("id").distinct(), "id", "left_semi").select("sale_month").distinct().collect()]
    months += [r.sale_month for r in new_sales.join(changed.select("id").distinct(), "id", "left_semi").select("sale_month").distinct().collect()]
    months = sorted(set(months), key=str)
    if not months:
        return []
    touched = F.coalesce(F.col("sale_month").isin([m for m in months if m is not None]), F.lit(False))
    if None in months:
        touched = touched | F.col("sale_month").isNull()
    rows = new_sales.where(touched)
    left = {r.sale_month for r in rows.select("sale_month").distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sale_month").parquet(path)
    for month in set(months) - left:
        folder = "__HIVE_DEFAULT_PARTITION__" if month is None else month
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/sale_month={folder}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return months


def report_for(shop, report_type: str, as_of, start: _dt.date | None = None, end: _dt.date | None = None,
               group_by: str = "day", inventory_type: str = "stock_summary", category_id=None,
               supplier_id=None, include_inactive: bool = False) -> tuple[DataFrame, DataFrame]:
    """A8 dispatch by report-type prefix: ``sales*`` (default the last 30
    days by day, each bound on its own; by product with its product summary), ``inventory*`` (default stock_summary), ``product*``.
    Returns (data, summary); an unknown type is an error."""
    if report_type.startswith("sales"):
        first, last = sal.rolling_window(as_of, 30)
        start, end = first if start is None else start, last if end is None else end
        return (sal.sales_by_period(shop.sales, shop.sale_items, start, end, group_by),
                (sal.sales_by_product_summary if group_by == "product" else sal.sales_period_summary)(
                    shop.sales, shop.sale_items, start, end))
    if report_type.startswith("inventory"):
        return (inv.inventory_report(shop.products, shop.categories, shop.suppliers, inventory_type),
                inv.inventory_report_summary(shop.products, inventory_type))
    if report_type.startswith("product"):
        return (inv.product_report(shop.products, shop.categories, shop.suppliers, category_id, supplier_id,
                                   include_inactive),
                inv.product_report_summary(shop.products, shop.categories, shop.suppliers, category_id,
                                           supplier_id, include_inactive))
    raise ValueError(f"unknown report type: {report_type}")


def export_report(shop, report_type: str, base_path: str, as_of, fmt: str = "csv",
                  now: _dt.datetime | None = None, **kwargs) -> dict[str, str]:
    """Build the report and write it under a time-stamped name:
    ``<base>/<report_type>_report_<YYYYmmdd_HHMMSS>/{data,summary}``.
    CSV carries the data only in the reference; here both parts are written."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    stamp = (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    data, summary = report_for(shop, report_type, as_of, **kwargs)
    return export_pair(data, summary, f"{base_path.rstrip('/')}/{report_type}_report_{stamp}", fmt)
