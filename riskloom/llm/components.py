"""Connected components of a link table by alternating stars; every round is joins and grouped minima in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b: hang neighbours on the least one, the greater neighbours (large) or the smaller ones (small)."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Every neighbour above its node moves to the least of that node's neighbours.
        moved = links.select(F.col("b").alias("a"), F.col("a").alias("up")).join(least, "a").select(F.col("up").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node of (a, b) long links; root is the least node of its component."""
    now = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.max("a").alias("m")).collect()[0]
        return r["n"], r["h"], r["m"]

    seen = state(now)
    while seen[0]:
        now = cut_lineage(_stars(_stars(now, True), False))
        last, seen = seen, state(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
