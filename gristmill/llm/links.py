"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node reachable from every node of the links (a, b).

    Every round points a node's larger neighbours at its least one, then the node
    and its smaller neighbours at the least. Minima are aggregated before the
    shuffle and joined back, so a node with very many links is no hot group.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    total = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.filter("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(least, large.u == F.col("_u"))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        new = scratch.keep(small.filter("u != v").distinct(), "edges")
        scratch.drop(edges, large)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
