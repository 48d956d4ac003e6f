"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(near: DataFrame, kept: DataFrame) -> DataFrame:
    """Link every neighbour in ``kept`` (a, b) to the least node that ``near`` knows around a."""
    least = near.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return table(least, "least").join(kept, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge list (a, b) of comparable columns; root is the least node reachable.

    Work is a shuffle of the edges for each step; the number of rounds grows with the logarithm of the
    node count. Nothing but a count and two checksums comes to the driver. Hubs are met by partial
    aggregation and by joins of two written tables, whose skewed partitions AQE splits. Null nodes and
    self-links are ignored; an empty edge list gives an empty result.
    """
    edges = table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        large = _both(edges)
        edges = table(_star(large, large.where("b > a")).distinct(), "large")
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        own = down.select("a", F.col("a").alias("b")).distinct()
        edges = table(_star(down, down.unionByName(own)).distinct(), "small")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
