"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours onto the smallest node around: larger ones (large star) or all smaller ones (small star)."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = around.join(least, "u")
    if large:
        hung = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of the component.

    Columns u and v are longs. A few rounds (logarithmic in the size of a component), each of
    them joins on nodes with combined minima; every round is staged, nothing is collected.
    """
    edges = stage(edges.select("u", "v").filter("u != v").distinct(), "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = stage(_stars(stage(_stars(edges, True), "stars"), False), "edges")
    hung = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root")).distinct()
