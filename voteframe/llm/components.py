"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voteframe.session import cut_lineage

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge, the component being its smallest node.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest node
    seen; edges end as one star per component after a number of rounds that grows with the
    logarithm of a component's width. A node with very many neighbours is aggregated before the
    shuffle, and its joins are ordinary joins that adaptive execution splits. Edges stay in the
    shared folder; the driver sees a count and a checksum per round.
    """
    high, low = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = edges.where(F.col(a) != F.col(b)).select(high, low).distinct()
    now = cut_lineage(now, "edges")
    seen = _state(now)
    for _ in range(ROUNDS):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(down, "hi")
        now = pairs.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            down.select("hi", F.col("m").alias("lo"))
        ).distinct()
        now = cut_lineage(now, "edges")
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    checksum = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), checksum).first())
