"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staging, cleaned


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then the edges (node, smaller node) that it leaves."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Small star over edges (node, smaller node)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, staging: Staging, name: str = "cc") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Large-star and small-star rounds alternate on the edge table, which never
    grows, until a round changes nothing; every round's edges are a written
    table, so that neither lineage nor the driver holds them. `edges` has the
    columns a, b; loops and repeats do no harm, and no edges give no rows.
    """
    now = staging.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    sign, i = None, 0
    while True:
        i += 1
        now = staging.write(_small(_stars(now)), f"{name}-{i}")
        staging.drop(f"{name}-{i - 1}")
        with cleaned(now.sparkSession):
            row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == sign:
            break
        sign = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
