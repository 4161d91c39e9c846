"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.scratch import Scratch


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(id, component) of every end of an edge (a, b); a component is named by its smallest id.

    Each round hangs every vertex under its smallest neighbour, shortens the resulting trees to
    their roots and replaces the ends of edges by roots; what is left halves at least.  A hub
    of any degree is summed before the shuffle.  The rows stay in Spark; the driver sees counts.
    """
    left = tmp.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = tmp.write(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")))
    while not left.isEmpty():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("p")).union(left.select("b", "a"))
        trees = tmp.write(both.groupBy("v").agg(F.least(F.min("p"), F.col("v")).alias("p")))
        while True:
            up = trees.select(F.col("v").alias("p"), F.col("p").alias("top"))
            shorter = tmp.write(trees.join(up, "p").select("v", F.col("top").alias("p"), (F.col("top") < F.col("p")).alias("moved")))
            tmp.drop(trees)
            trees = shorter
            if trees.where("moved").isEmpty():
                break
        to = trees.select("v", "p")
        merged = tmp.write(
            roots.join(to, roots["component"] == to["v"], "left").select("id", F.coalesce("p", "component").alias("component"))
        )
        a = to.select(F.col("v").alias("a"), F.col("p").alias("x"))
        b = to.select(F.col("v").alias("b"), F.col("p").alias("y"))
        fewer = left.join(a, "a").join(b, "b").where("x <> y")
        fewer = tmp.write(fewer.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        for old in (left, roots, trees):
            tmp.drop(old)
        left, roots = fewer, merged
    return roots
