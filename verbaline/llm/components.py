"""Connected components of a graph held as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import drop, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (self loops do no harm).

    Each round makes every node point at the smallest of its neighbours; the minimum is a partial aggregate, so a hub
    costs one row per task, and the edges meet it in a plain equi-join that Spark may split when skewed. The rounds end
    when the edge set no longer changes; their number is logarithmic in the longest path. Nulls on an edge are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.where("u > m").select("u", F.col("m").alias("v"))
        e1 = written(large.union(own).where("u <> v").distinct(), "edges")
        least = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e2 = written(small.where("u <> v").distinct(), "edges")
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(e)
        drop(e1)
        e = e2
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots)
