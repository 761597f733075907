"""Connected components of an edge table by alternating large and small stars.

Edges stay distributed; each round is two aggregations and joins on vertices, written to the shared folder in place of the round
before, and the number of rounds grows with the logarithm of the longest path. Hot vertices are pre-aggregated, and their joins may be
split by AQE. Self loops, repeated edges and an empty table are allowed; isolated vertices do not occur in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every vertex of ``edges`` (a, b long)."""
    tables = Scratch(edges.sparkSession, "components")
    now = tables.write("edges-0", edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for k in range(rounds):
        now = tables.write(f"edges-{k + 1}", _small_star(_large_star(now)))
        tables.drop(f"edges-{k}")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
