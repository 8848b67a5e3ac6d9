"""Connected components of a graph given by pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every id in edges (a, b); component is the least id reachable.

    Alternating large and small stars: each round links nodes to the least of their neighbours, by aggregates that sum
    before the shuffle and joins that Spark can split, so that a hub's neighbours never meet in one task. Rounds are
    stored, and end when the stars no longer change. Nulls and loops are left out; repeated pairs do no harm.
    """
    now = common.stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("e")).select("e.*").where("v <> m").distinct()
        now = common.stored(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.sum(F.xxhash64("m", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
