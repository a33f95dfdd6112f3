"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel

HOT = 1_000_000  # neighbours: the rows of a node with more go to no one task


def least(rows: DataFrame, top: int) -> DataFrame:
    """rows (a, b) with m, the least b of each a. top: how many rows an a may have."""
    over = F.min("b").over(Window.partitionBy("a"))
    if top <= HOT:
        return rows.withColumn("m", over)
    # Partial aggregation finds the least of the few that have very many, and they are told to the rows where these lie.
    hot = kernel.small(rows.groupBy("a").agg(F.min("b").alias("hot_least"), F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("a").alias("hot"), "hot_least"))
    marked = rows.join(hot, F.col("a") == F.col("hot"), "left")
    return marked.where("hot is null").select("a", "b").withColumn("m", over).unionByName(marked.where("hot is not null").select("a", "b", F.col("hot_least").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; a component is named by its least node.

    Loops and repeated edges change nothing; edges with a null end are left out. Each round is
    a few shuffles of the edges that remain, and their number falls to one a node in a number of
    rounds that grows with the logarithm of the nodes. Each round is cut in the shared folder.
    A node that very many edges name, such as the least of a large component, is no one task's.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = kernel.cut(now)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degrees = both.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        size = degrees.agg(F.sum("n"), F.sum("h"), F.max("n").alias("top")).first()
        if size == before or not size[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = size
        large = least(both, size.top).withColumn("m", F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = least(large, size.top).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = kernel.cut(small)
