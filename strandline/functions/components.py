"""Connected components of undirected edges, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import Turns


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node that each node reaches. Loops and repeats don't matter.

    Rounds are written as tables, whose sizes Spark knows. A checkpoint keeps the estimate of the plan that it cuts off,
    and that of a join is a product: from round to round its digits would multiply by four.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    turns = Turns(edges.sparkSession, 8)
    now = turns.put(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = mark(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = turns.put(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        large = turns.put(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = turns.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = turns.put(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        new = mark(now)
        if new == was:
            break
        was = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
