"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node that
    can be reached. Each round is a few pre-aggregated minima and joins by node (skew is
    split by AQE) and is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain. The smallest neighbour is found before edges
    move, so a node with very many neighbours is never gathered."""
    star = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = shared.stored(star, tag)
    for _ in range(most_rounds):
        if _settled(star):
            break
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared.stored(large, tag)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        star = shared.stored(small, tag)
    else:
        if not _settled(star):
            raise RuntimeError("components did not settle")
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settled(star: DataFrame) -> bool:
    """Whether every node points to one smaller node, and no node that is pointed to
    points further: then the edges are the stars of the components."""
    ends = star.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        star.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").isEmpty()


def forest_roots(links: DataFrame, tag: str = "forest") -> DataFrame:
    """(node, root) for every node of a forest, given as one row (u, v) for each node u
    that has a parent v. Pointers are doubled, so the rounds are the logarithm of the
    depth; a node that has reached its root is not joined again."""
    way = shared.stored(links.select("u", "v", F.lit(True).alias("open")), tag)
    while not way.where("open").isEmpty():
        beyond = way.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jumped = way.where("open").join(beyond, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("open"))
        way = way.where("not open").unionByName(shared.stored(jumped, tag))
    roots = way.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(way.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
