"""Connected components of an undirected graph given as edges of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import discard, write_through


def _settled(pairs: DataFrame) -> bool:
    """Whether every node of the distinct pairs (u, v) either hangs on one root or is a root."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
    )).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return roles.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (u, v); the component is its smallest node.

    Every round hangs each node's larger neighbours, then its smaller ones, on the
    smallest it knows, which halves the depth; rounds are written tables, so nothing is
    computed twice.  Hubs cost one partial minimum and a join that can be split.
    """
    ends = edges.where("u <> v")
    pairs = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = write_through(pairs, "component-edges")
    for _ in range(max_rounds):
        if _settled(pairs):
            break
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        # v stands for the smallest node of its neighbourhood, so it is below u, and m is v or below
        small = large.join(lower, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v")
        after = write_through(small.where("u <> v").distinct(), "component-edges")
        discard(pairs)
        pairs = after
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
