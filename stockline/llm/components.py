"""Connected components of a large edge table by alternating large-star and small-star steps.

Each step is a map-side combined minimum per node and one equi-join, so a hub with many neighbours
is pre-aggregated before the shuffle and its edges can be split by the skew-join rule. Edges stay in
tables of the shared folder; nothing but two numbers per round reaches the driver. The number of
rounds grows with the logarithm of the largest component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.storage import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(
            least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Direction, repeated edges, loops and nulls do not matter (edges with a null end are ignored).
    Nodes without an edge are not listed. An empty edge table gives an empty result."""
    current = stored(edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        following = stored(_star(_star(current, large=True), large=False), "edges")
        drop_stored(current)
        current = following
    # At the fixed point every node points to the smallest node of its component.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
