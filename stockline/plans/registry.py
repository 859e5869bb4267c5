"""Named queries over the driver's tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. Parameters are
fixed here so that the same query can be run by the correctness gate and the
benchmark; every query reads whole tables (date windows and top-N limits are
the operator's own feature, not a sample).
"""

from __future__ import annotations

import datetime as _dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from stockline.sources.views import AS_OF, driver_shop

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Fixed parameters of the registered queries.
FULL_START = _dt.date(1995, 1, 1)   # first order date of the test data
FULL_END = AS_OF                    # last order date of the test data


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


_STORED: dict[str, str] = {}


def use_stored(sf_dir: str, database: str | None) -> None:
    """Serve ``sf_dir`` from the bucketed catalog tables of ``database``
    (see :mod:`stockline.sources.store`), or from the views again (None)."""
    if database:
        _STORED[sf_dir.rstrip("/")] = database
    else:
        _STORED.pop(sf_dir.rstrip("/"), None)


def shop(spark: SparkSession, sf_dir: str):
    db = _STORED.get(sf_dir.rstrip("/"))
    if db:
        from stockline.sources.store import stored_shop
        return stored_shop(spark, db)
    return driver_shop(spark, sf_dir)


def present(df: DataFrame) -> DataFrame:
    """Calendar dates as ISO text (``yyyy-MM-dd``) and money as double, the
    forms the reports hand out; every other column is left as it is."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DateType, DecimalType
    fields = df.schema.fields
    if not any(isinstance(f.dataType, (DateType, DecimalType)) for f in fields):
        return df

    def one(f):
        if isinstance(f.dataType, DateType):
            return F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name)
    return df.select(*[one(f) for f in fields])


def all_queries() -> dict[str, QueryFn]:
    # Importing the modules fills the registry.
    from stockline.plans import (q_sales, q_inventory, q_catalog, q_changes,  # noqa: F401
                                 q_quality, q_sinks)
    return {name: (lambda spark, sf, _fn=fn: present(_fn(spark, sf))) for name, fn in REGISTRY.items()}
