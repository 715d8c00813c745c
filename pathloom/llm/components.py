"""Connected components of a graph given by its edges, by alternating large and small stars, as DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, drop, stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    return both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
    moved = down.join(least, F.col("a") == F.col("_a")).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (a != b, any type that orders and joins), best a stored table. Gives node, component (the component's least node); nodes without edges don't occur.

    Each round is a table in the shared folder, deleted after the next; rounds grow with the logarithm of the longest path. Only a count and a sum of
    hashes of each round reach the driver.
    """
    mark, last, now = None, None, edges.select("a", "b").where("a <> b")
    while True:
        now = stored(_small(_large(now)).where("a <> b").distinct(), "stars")
        if last is not None:
            drop(last)
        last = now
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    collect_garbage(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
