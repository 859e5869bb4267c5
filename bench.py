"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full through the ``noop`` sink (every row is
computed, nothing is collected), once to warm up and then ``$BENCH_RUNS``
times; the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sales_by_day", "sales_by_week", "sales_by_month", "sales_period_summary", "sales_by_product",
    "sales_by_product_summary", "sales_by_product_id", "sales_summary", "most_sold_30d", "daily_sales",
    "top_by_revenue", "inventory_report", "inventory_summary", "product_report", "product_report_summary",
    "category_distribution", "category_performance", "product_search", "sale_list", "sale_table",
    "sale_with_items", "priced_lines", "priced_sales", "sale_numbers", "stock_check", "cancel_sales_stock",
    "dq_sale_lines", "dq_unique", "dq_foreign_keys", "post_sales",
]


STORED_SET = ["sales_by_day", "sales_period_summary", "sales_by_product", "most_sold_30d", "daily_sales",
              "sale_table", "sale_with_items", "priced_sales", "category_performance", "inventory_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from stockline.plans.registry import all_queries
    from stockline.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app_name="stockline-bench")
    queries = all_queries()
    timings: dict[str, float] = {}
    for name in only or HEADLINE:
        fn = queries[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
    # Secondary: the same reports on the stored layout (bucketed, month-partitioned
    # tables written once by an ETL step), as they would run on a cluster.
    stored: dict[str, float] = {}
    etl = None
    if os.environ.get("BENCH_STORED", "1") == "1" and not only:
        from stockline.plans.registry import use_stored
        from stockline.session import scratch_path
        from stockline.sources.store import store_shop
        from stockline.sources.views import driver_shop
        db = "bench_" + str(int(time.time()))
        t0 = time.perf_counter()
        store_shop(spark, driver_shop(spark, sf_dir), db, scratch_path(spark, "bench-store"), buckets=cpus)
        etl = round(time.perf_counter() - t0, 3)
        use_stored(sf_dir, db)
        for name in STORED_SET:
            samples = []
            for i in range(runs + 1):
                t0 = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:
                    samples.append(time.perf_counter() - t0)
            stored[name] = round(statistics.median(samples), 3)
        use_stored(sf_dir, None)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(timings.values()), 3),
           "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus, "runs": runs,
           "spark": spark.version, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    if stored:
        out["stored_layout"] = {"etl_sec": etl, "queries": stored,
                                "sum_sec": round(sum(stored.values()), 3)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
