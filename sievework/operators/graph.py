"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.storage import remove, scratch, written


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root) of all ends of edges (src, dst): root is the smallest id that they are linked to.

    Ends can be of any type that has an order. Large-star and small-star steps
    take turns until only stars are left, which takes rounds that grow with the
    logarithm of the longest path. Each round is written to the shared folder,
    and the one before it removed. No edge is dropped: a graph that needs more
    than most_rounds rounds, with a path of some 2**most_rounds edges, raises.
    """
    spark = edges.sparkSession
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    now = written(both, "edges", path := scratch(spark, "edges"))
    for _ in range(most_rounds):
        around = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        # The key is another one than that of the sums, so both sides are dealt out for the join, and Spark can split a hub's rows.
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.struct("u").alias("key"), "m")
        large = around.withColumn("key", F.struct("u")).join(low, "key").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # Small star: to the smallest neighbour go the node itself and its smaller neighbours.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(down.select("m", "b")).distinct()
        last, path = path, scratch(spark, "edges")
        now = written(small, "edges", path)
        remove(spark, last)
        # Stars: each node has one neighbour below it, and that one has none.
        once = now.groupBy("b").agg(F.count("*").alias("n"))
        if not once.where("n > 1").limit(1).count() and not now.join(once.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            ends = now.select(F.col("b").alias("id"), F.col("a").alias("root"))
            return ends.union(now.select("a", "a").distinct())
    raise RuntimeError("components did not settle")
