"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join; labels stay in written tables, nothing goes to the driver but a
count and a checksum.  The number of rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import forget, materialize, salted_join


def _met(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ways: (u, v).  Each with m, the least v of its u; the ways of a node with very many are dealt to several tasks."""
    least = materialize(ways.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return salted_join(ways, least, ["u"], "n", F.xxhash64("v")).drop("n"), least


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    met, least = _met(both)
    met = met.filter("v > u").withColumn("m", F.least("u", "m"))
    return met.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    met, least = _met(down)
    to = met.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return to.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), least


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one ordered type.  Returns (node, component) for every node that has an edge to another
    node; component is the least node.  Stars are stable under both steps, so equal marks mean the end."""
    mark, before = None, []
    while True:
        large, first = _large_star(edges)
        large = materialize(large, "large-star")
        small, second = _small_star(large)
        edges = materialize(small, "small-star")
        forget(*before, first, second, large)
        before = [edges]
        now = _mark(edges)
        if now == mark or now[0] == 0:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b"), F.col("b")).distinct())
