"""A1: table scans.

The shop is six tables. They are read either from stored parquet (the normal
case on a cluster: one folder per table, written by :mod:`stockline.sources.sinks`)
or from a live database over JDBC with a partition column, or they are derived
from the driver's TPC-H style tables by :mod:`stockline.sources.views`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from stockline import schema as S

TABLE_NAMES = ("categories", "suppliers", "products", "sales", "sale_items", "users")

SCHEMAS = {
    "categories": S.CATEGORIES, "suppliers": S.SUPPLIERS, "products": S.PRODUCTS,
    "sales": S.SALES, "sale_items": S.SALE_ITEMS, "users": S.USERS,
}


@dataclass
class Shop:
    """The six tables of one shop, each built on first use.

    Frames are lazy plans: building a ``Shop`` reads nothing, and an operator
    that never touches ``users`` never plans a scan of it.
    """

    builders: dict[str, Callable[[], DataFrame]]
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.builders[name]()
        return self._cache[name]

    @property
    def categories(self) -> DataFrame:
        return self.table("categories")

    @property
    def suppliers(self) -> DataFrame:
        return self.table("suppliers")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def sales(self) -> DataFrame:
        return self.table("sales")

    @property
    def sale_items(self) -> DataFrame:
        return self.table("sale_items")

    @property
    def users(self) -> DataFrame:
        return self.table("users")

    def replace(self, **frames: DataFrame) -> "Shop":
        """A new shop with some tables swapped (e.g. a new products snapshot)."""
        builders = dict(self.builders)
        for name, df in frames.items():
            builders[name] = (lambda d=df: d)
        return Shop(builders)


def read_parquet_shop(spark: SparkSession, base: str) -> Shop:
    """Six stored tables under ``base/<table>`` (parquet, any partitioning)."""
    return Shop({name: (lambda n=name: spark.read.schema(SCHEMAS[n]).parquet(f"{base}/{n}"))
                 for name in TABLE_NAMES})


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str,
                    lower: int, upper: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """A1 over a live database: a partitioned JDBC read, so the scan is split
    into ``partitions`` range queries on ``partition_column`` instead of one."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties=properties or {})


def read_source(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table; ``columns`` prunes the parquet read explicitly."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
