"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._scratch import Scratch

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node links its greater neighbours to its least one. Small: its lesser neighbours and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, root) for each node of edges(u, v): root is the least node of its component.

    Each round is written to the shared folder; the rounds end when the edges form stars, after about
    log(longest path) of them. Self-loops and repeated edges are ignored; no edges give no rows.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for i in range(1, ROUNDS):
        # A star forest: no node has two parents and no parent has one.
        marks = now.groupBy("u").count().select("u", "count").join(now.groupBy(F.col("v").alias("u")).agg(F.lit(1).alias("is_root")), "u", "left")
        if marks.where("count > 1 or is_root = 1").isEmpty():
            break
        now = scratch.write(_star(_star(now, large=True), large=False), f"{name}-{i}")
        scratch.release(f"{name}-{i - 1}")
    else:
        raise RuntimeError("the components did not settle")
    return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
