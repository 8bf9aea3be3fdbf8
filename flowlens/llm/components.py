"""Connected components of an edge table by alternating large-star and small-star steps.

All work is joins and grouped minima over the edge table; no neighbour list is ever
gathered, so a hub with a third of all edges is split like any other join key. Every round
is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return (linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any ordered type -> ``(node, root)`` of every node that has an edge
    to another one; ``root`` is the smallest node of its component.

    Null ends, self links and repeated edges are allowed and change nothing; an empty table
    gives an empty result.
    """
    edges = C.staged(edges.where("u is not null and v is not null and u <> v")
                     .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .distinct(), "cc")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
        edges = C.staged(_small_star(_large_star(edges)), "cc")
