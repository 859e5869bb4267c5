"""Stored layout: same answers as the views, co-located joins, pruned months."""
import datetime as dt
import os
import tempfile
import uuid

from stockline.operators import sales as sal
from stockline.sources.store import store_shop, stored_shop
from stockline.sources.views import driver_shop

SF = "/root/testdata/sf0.001"


def test_bucketed_store(spark):
    if not os.path.isdir(SF):
        return
    db = "t_" + uuid.uuid4().hex[:8]
    store_shop(spark, driver_shop(spark, SF), db, tempfile.mkdtemp(prefix="stockline-store-"), buckets=8)
    stored, views = stored_shop(spark, db), driver_shop(spark, SF)
    a, b = dt.date(1998, 1, 1), dt.date(1998, 3, 31)
    got = sal.sales_by_period(stored.sales, stored.sale_items, a, b, "day")
    want = sal.sales_by_period(views.sales, views.sale_items, a, b, "day")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0
    # co-located: the sale <-> line join and the per-sale count need no exchange on the sale key
    disabled = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = sal.sales_by_period(stored.sales, stored.sale_items, a, b, "day")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", disabled)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan
    assert "hashpartitioning(id" not in plan and "hashpartitioning(sale_id" not in plan
    # the month range reaches the partition filter
    assert "PartitionFilters: [isnotnull(sale_month" in plan and "1998-01" in plan
