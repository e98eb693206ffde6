"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written


def _settled(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, and that one has none itself."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        .alias("e")).select("e.*")
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty()


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    return links.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """Rows of (node, component) for every node of ``links`` (a, b), both long.

    The component is the smallest node that links reach. Links may be repeated, in
    either direction; nulls link nothing. Alternating stars: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows, until all hang on
    the smallest node of their component. A node with very many links is one aggregate row before it is shuffled, and
    the links beside it are on the side of the join that adaptive execution can split.
    Each round is written to the shared folder, so rounds survive lost executors and
    plans stay short.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = links.dropna().where(F.col("a") != F.col("b")).select(
        high.alias("a"), low.alias("b")).distinct()
    links = written(links, "links")
    while not _settled(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, F.col("a") == F.col("node")).where(
            F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = _least(large, "a", "b")
        small = large.join(least, F.col("a") == F.col("node")).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("least").alias("b"))))
            .alias("l")).select("l.a", "l.b")
        links = written(small.where(F.col("a") != F.col("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))
                          .distinct())
