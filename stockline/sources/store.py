"""The stored layout for large data: the six tables as catalog tables.

- ``sales`` is partitioned by ``sale_month`` (``yyyy-MM``) and bucketed and
  sorted by ``id``; ``sale_items`` is bucketed and sorted by ``sale_id`` with
  the same bucket count. Joins and per-sale aggregates between the two then
  read co-located buckets: no exchange of either side. A date window on
  ``sale_date`` also gets the implied ``sale_month`` range
  (:func:`stockline.operators.sales.completed_between`), so whole months are
  skipped by partition pruning.
- ``products`` is bucketed by ``id`` (the key of every product join).
- The small dimensions are plain tables.

Written once by an ETL job (``store_shop``), read by every report
(``stored_shop``). Each table is repartitioned on its bucket key before the
write, so every bucket is one file per partition instead of one per task.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from stockline.functions.exprs import day_of, month_key
from stockline.sources.tables import TABLE_NAMES, Shop


def store_shop(spark: SparkSession, shop: Shop, database: str, location: str | None = None,
               buckets: int = 64, mode: str = "errorifexists") -> None:
    """Write the shop as bucketed catalog tables of ``database``."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{loc}")
    sales = shop.sales.withColumn("sale_month", month_key(day_of("sale_date")))
    (sales.repartition(buckets, "id").write.mode(mode).partitionBy("sale_month")
     .bucketBy(buckets, "id").sortBy("id").saveAsTable(f"{database}.sales"))
    (shop.sale_items.repartition(buckets, "sale_id").write.mode(mode)
     .bucketBy(buckets, "sale_id").sortBy("sale_id").saveAsTable(f"{database}.sale_items"))
    (shop.products.repartition(buckets, "id").write.mode(mode)
     .bucketBy(buckets, "id").sortBy("id").saveAsTable(f"{database}.products"))
    for name in ("categories", "suppliers", "users"):
        shop.table(name).coalesce(1).write.mode(mode).saveAsTable(f"{database}.{name}")


def stored_shop(spark: SparkSession, database: str) -> Shop:
    """The shop read from the bucketed catalog tables."""
    return Shop({name: (lambda n=name: spark.table(f"{database}.{n}")) for name in TABLE_NAMES})
