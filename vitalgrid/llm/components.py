"""Connected components over an edge table, by alternating large-star and small-star steps.

Each half-step is one aggregation and one join, written to the shared folder; the loop ends when the edges no longer
change, after a number of rounds that grows with the logarithm of the longest path.  Least neighbours are written before
they are joined: as a table of their own they are broadcast where they are few, and else Spark can split the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id that can be reached."""
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct()
    e = materialize(e, "edges")
    seen = None
    while (state := _state(e)) != seen and state[0]:
        seen = state
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), "lows")
        large = both.where(v > u).join(small(low), "u").select(v.alias("u"), F.col("low").alias("v")).where(u != v).distinct()
        large = materialize(large, "edges")
        discard(e, low)
        e = large
        low = materialize(e.groupBy("u").agg(F.min("v").alias("low")), "lows")
        rest = e.join(small(low), "u").select(v.alias("u"), F.col("low").alias("v")).where(u != v)
        e = materialize(rest.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
        discard(large, low)
    return e.select(u.alias("id"), v.alias("component")).unionByName(e.select(v.alias("id"), v.alias("component")).distinct())
