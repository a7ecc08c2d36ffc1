"""Connected components of an edge list, on the cluster, by alternating star steps.

Every round hangs each node's larger neighbours under its smallest neighbour and then does
the same for the smaller ones, so paths shrink by half or more per round. Rounds are written
to the shared checkpoint folder; only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    moved = edges.join(least, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge and is not the smallest of its component.

    ``edges`` may repeat pairs, name them in either order and hold self-loops or nulls (ignored)."""
    x, y = F.col(a), F.col(b)
    stars = materialize(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = _state(stars)
    while state[0]:
        stars = materialize(_small_star(_large_star(stars)))
        state, before = _state(stars), state
        if state == before:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
