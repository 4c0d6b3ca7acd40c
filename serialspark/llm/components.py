"""Connected components of a graph given as edges, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def _star(edges: DataFrame) -> DataFrame:
    """edges: (u, v). Adds m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Loops and nulls are left out, repeated edges count once, an empty table gives an empty one.
    Each round is cut off as a table in the shared folder, which goes when the next is stored; it ends when a round changes nothing.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    scratch = Scratch(edges.sparkSession)
    e = scratch.written(e, "edges")
    last = None
    for _ in range(rounds):
        before = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        e = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = scratch.written(e, "edges")
        scratch.drop(before)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    out = written(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    scratch.drop(e)
    return out
