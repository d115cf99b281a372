"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); the label is the smallest node.

    Each step links neighbours to the smallest of them, aggregated before the shuffle, so a hub
    is not collected; tables go to the shared folder between steps.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        # large star: larger neighbours of each node go to the smallest of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        after = cut(small, "edges")
        changed = not after.join(e, ["u", "v"], "left_anti").isEmpty() or not e.join(after, ["u", "v"], "left_anti").isEmpty()
        e = after
        if not changed:
            break
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
