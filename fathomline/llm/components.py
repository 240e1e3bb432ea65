"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; edges run from the larger end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, ws: Workspace, label: str, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Self-loops, repeated and reversed edges and edges with a null end are ignored.
    Every pass is a partial aggregate, an equi-join that AQE may split, and a table in the shared
    folder; only two numbers reach the driver. Passes go on until one changes nothing, about the
    square of the logarithm of the longest path of them, so a result is never partial.
    """
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    current = ws.put(pairs.distinct(), f"{label}-0")
    state = _state(current)
    for k in count(1):
        after = ws.put(_small_star(_large_star(current).distinct()).distinct(), f"{label}-{k}")
        now = _state(after)
        ws.drop(f"{label}-{k - 1}")
        current, before, state = after, state, now
        if before == now:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
