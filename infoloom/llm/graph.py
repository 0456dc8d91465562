"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, small: bool, spent: list[DataFrame]) -> DataFrame:
    """One contraction of edges ``(u, v)``, u > v: every node hands its neighbours the smallest of them and itself.

    The smallest neighbour comes from an aggregation with partial sums before its shuffle, and
    the edges then meet it in a plain equi-join, which Spark can split where one node holds many edges.
    ``spent`` gets the table of these, which may go once the edges are written.
    """
    if small:
        out = edges
    else:
        out = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that both sides of the join are plain shuffles
    least = written(out.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    spent.append(least)
    met = out.join(least, "u")
    if small:
        new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        new = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return new.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of all nodes of the edges ``(u, v)`` but the roots; a root is the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes (Kiveris et al., 2014), which takes a number of
    rounds that grows with the logarithm of the longest path. Each round is written to the checkpoint folder and the one before removed; only
    counts and a checksum reach the driver. Self-loops, repeated and null edges are passed over.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    )
    now = written(ordered.distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    at = state(now)
    if at[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        spent = [now]
        now = written(_star(_star(now, False, spent), True, spent))
        discard(*spent)
        after = state(now)
        if after == at:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        at = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
