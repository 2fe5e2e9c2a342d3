"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Workspace


def connected_components(links: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node reachable.

    Each round is two map-side combined aggregations and two joins whose sides are plain exchanges; both halves of it
    are written before the next starts. Self-links are ignored; null ends too; no links give no rows.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a <> b").distinct()
    stars, last, k = ws.save(links, f"{name}-0"), None, 0
    while True:
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == last:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last, k = state, k + 1
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ws.save(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"{name}-{k}-l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        stars = ws.save(small.distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}", f"{name}-{k}-l")
