"""Skew-safe running totals equal a plain window, with one hot group."""
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockline.plans.ordered import running_totals


def test_running_totals_hot_group(spark):
    rnd = random.Random(3)
    rows = [(i, 0 if rnd.random() < 0.4 else rnd.randint(1, 30), rnd.randint(0, 500), rnd.randint(1, 9))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g long, t long, q long")
    out = running_totals(df, ["g"], ["t", "id"], {"rn": None, "cq": "q"}, partitions=16)
    w = W.partitionBy("g").orderBy("t", "id")
    ref = df.select("id", F.row_number().over(w).alias("rn0"),
                    F.sum("q").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cq0"))
    j = out.join(ref, "id")
    assert j.count() == 6000
    assert j.where((F.col("rn") != F.col("rn0")) | (F.col("cq") != F.col("cq0"))).count() == 0
