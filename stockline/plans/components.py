"""Connected components of an edge table, in a logarithmic number of rounds.

Every node keeps the smallest node it has heard of. A round lets each node hear of the smallest mark among its
neighbours (a map-side combined minimum, so a hub is no hot task), and then of the mark of its mark, which halves
the distance to the smallest node each time. Marks are cut from their lineage after every round; only a count
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.session import cut_lineage


def component_marks(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node. Direction, loops and
    repeated edges do not matter; edges with a null end are ignored."""
    given = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = cut_lineage(given.union(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    marks = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("mark"))
    marks = cut_lineage(marks.withColumnRenamed("a", "node"))
    while True:
        heard = (both.join(marks, both.b == marks.node).groupBy("a").agg(F.min("mark").alias("heard"))
                 .withColumnRenamed("a", "node"))
        # What a node hears is passed on to its mark too: otherwise only one side of an old link would learn of it.
        told = marks.join(heard, "node")
        offers = (told.select("node", F.least("mark", "heard").alias("mark"), F.col("mark").alias("was"))
                  .union(told.select(F.col("mark").alias("node"), F.col("heard").alias("mark"), F.lit(None).cast("long")))
                  .groupBy("node").agg(F.min("mark").alias("mark"), F.max("was").alias("was")))
        onward = offers.select(F.col("node").alias("mark"), F.col("mark").alias("onward"))
        following = cut_lineage(offers.join(onward, "mark", "left").select(
            "node", F.least("mark", F.coalesce("onward", "mark")).alias("mark"), "was"))
        changed = following.where("mark < was").limit(1).count()
        marks = following.drop("was")
        if not changed:
            return marks.withColumnRenamed("mark", "component")
