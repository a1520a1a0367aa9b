"""Connected components by alternating large-star and small-star, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    A round costs a few small shuffles; the least neighbours are stored before they are joined back, so that adaptive execution can split a node with very many
    edges. Edges only ever move to smaller neighbours, so the number of rounds is logarithmic in practice.
    Only a count and a checksum reach the driver. Loops and repeated edges are ignored, and null ends dropped.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, mark = stored(e, "cc-edges"), None
    while True:
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if now == mark or not now[0]:
            break
        mark, before = now, e
        # Large-star: the neighbours above u join the smallest neighbour of u.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "cc-edges")
        # Small-star: u and its neighbours below join the smallest of them.
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        e = stored(small.where("u <> v").distinct(), "cc-edges")
        discard(before, large, least, low)
    tops = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
