"""Connected components over edge tables (G4), as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) with u > v are stars: no node points at two others, and none that is pointed at points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.agg(F.count_if(F.expr("out > 1 or (out > 0 and into > 0)"))).first()[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that an edge touches, with the smallest node of its component.

    Each round points neighbours at the smallest neighbour, once among larger and once among smaller ones, so the number
    of rounds grows with the logarithm of the diameter; edges that are stars already take none. Minima are partially
    aggregated before they are shuffled, and every round is written to the shared folder. Null ends are ignored; a
    self-loop gives a component of one node.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = now.where("u = v")
    now, last = now.where("u <> v"), None
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = last = written(small, last)
    else:
        if not _settled(now):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(stars.unionByName(roots).select("node"), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone).distinct()
