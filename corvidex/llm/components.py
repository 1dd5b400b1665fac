"""Connected components of a link table, by alternating large-star and small-star steps.

Nothing but counts reaches the driver. Each step is a partial aggregation and
equi-joins, and is cut by a reliable checkpoint. Where one hub has most links, AQE
splits its partition of a join; it does so only if both sides come straight from
a shuffle, so they are joined by another key than the one they are aggregated by.

Cases: no links give an empty table; loops, repeated links and either direction
of a link are alike; links with a null end are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import cut


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the m of their u."""
    other = least.select(F.bitwise_not("u").alias("_k"), "m")
    return edges.withColumn("_k", F.bitwise_not("u")).join(other, "_k").drop("_k")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node it can reach. The steps go on until nothing changes: log² of the nodes at most."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print(edges)
    while before[0]:
        edges = cut(_small(_large(edges)))
        now = _print(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
