"""Connected components of an edge table by alternating stars.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star does the same for smaller neighbours (Kiveris et al.,
2014). Each star is a partial aggregate and a join, so a node with very many
neighbours is no group of one task; a round's edges are written to the shared
folder. The rounds end when the edges no longer change; they are stars then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (first two columns, longs); component is the smallest node reachable."""
    x, y = edges.columns[:2]
    now = edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = materialize(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if state == (state := _state(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
