"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (partially aggregated before its shuffle) and an equi-join, so a
component of any size is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``.

    The component is its least node. Self-loops are allowed, null ends are ignored, repeated
    edges count once, and no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large star: link every greater neighbour of u (and u) to the least of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(e.where("u = v")).distinct()
        # small star: link every lesser neighbour of u (and u) to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("x"), F.col("m").alias("v"))
        small = small.select(F.col("x").alias("u"), "v").where("u != v").unionByName(e.where("u = v")).distinct()
        e = materialize(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    comp = e.where("u != v").groupBy("u").agg(F.min("v").alias("component"))
    roots = comp.select(F.col("component").alias("u"), "component").distinct()
    loops = e.where("u = v").select("u", F.col("v").alias("component"))
    return comp.unionByName(roots).unionByName(loops).groupBy("u").agg(F.min("component").alias("component")).withColumnRenamed("u", "node")
