"""Write the shop's stored layout (bucketed, month-partitioned catalog tables).

Usage: python tools/store.py SF_DIR DATABASE [LOCATION] [BUCKETS]

Run once per data load; reports then read ``stored_shop(spark, DATABASE)``
(or ``stockline.plans.registry.use_stored``). On a cluster, pick BUCKETS so a
bucket of ``sale_items`` is a few hundred MB, and keep it the same for
``sales`` and ``sale_items`` (the function does).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    if len(sys.argv) < 3:
        raise SystemExit(__doc__)
    sf_dir, database = sys.argv[1], sys.argv[2]
    location = sys.argv[3] if len(sys.argv) > 3 else None
    buckets = int(sys.argv[4]) if len(sys.argv) > 4 else 64
    from pyspark.sql import SparkSession

    from stockline.sources.store import store_shop
    from stockline.sources.views import driver_shop
    spark = SparkSession.builder.getOrCreate()
    store_shop(spark, driver_shop(spark, sf_dir), database, location, buckets)


if __name__ == "__main__":
    main()
