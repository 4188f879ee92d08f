"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored


def _near(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) for every node of an edge.

    ``edges`` has two long columns; direction, loops and repeats don't matter, edges with a null
    end are ignored. Every round is written to the shared folder. Each node's smallest neighbour
    is combined before the shuffle and joined back, so a hub is a skewed join, never a group.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b))
    e = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: what is larger than u goes to u's smallest neighbour
        near = _near(both).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        # small star: u and what is smaller than u go to the smallest of them
        near = _near(large)
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(small.union(near).distinct(), "edges")
        forget(e, large)
        e = after
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
