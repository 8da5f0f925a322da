"""Connected components over an edge table: alternating large-star and small-star joins, each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any longs to (u, v): each node but the smallest of its component, with that smallest node.

    Loops and repeated edges are allowed, nulls are dropped; no edges give no rows. Each round keeps at most as many
    edges as before and pulls every node to a smaller neighbour; rounds grow with the logarithm of a component. Hubs
    are aggregated by min before their join, whose large side Spark splits.
    """
    a, b = F.greatest("u", "v"), F.least("u", "v")
    now = stored(edges.where("u <> v").select(a.alias("u"), b.alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low)
        now = stored(small.distinct(), "edges")
        state, before = _state(now), state
        if state == before:
            break
    return now
