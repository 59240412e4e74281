"""Connected components of an edge table by alternating large and small stars; every step is a join or a sum per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.llm.session import stored


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), "least")
    tied = down.join(least, F.col("a") == F.col("node"))
    return tied.select("a", F.col("least").alias("b")).union(tied.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` has columns a and b; gives node and root, the smallest node it reaches, for all nodes but the roots."""
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "component-edges")
    before = _size(edges)
    while before[0]:
        edges = stored(_small(_large(edges)), "component-edges")
        now = _size(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
