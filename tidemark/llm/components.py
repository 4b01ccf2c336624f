"""Connected components by alternating large and small stars, on edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_stored, stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Per u its lowest neighbour m, or u itself if that is lower. Pre-aggregated, so a hot u is cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored first, so that the join has shuffles of its own, of which adaptive execution can split that of a hot u
    return both.join(stored(_lowest(both), "lowest"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = stored(_lowest(down), "lowest")
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; root is the lowest node it is connected with. Nodes without
    links are absent. Each pass is stored; the passes grow with the logarithm of the longest path."""
    spark = links.sparkSession
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        after = stored(_small_star(_large_star(edges)).where("u <> v").distinct(), "edges")
        drop_stored(spark, edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(root.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "components")
