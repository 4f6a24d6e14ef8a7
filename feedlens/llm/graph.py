"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each vertex, and itself, to the least of all of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "stars-least")
    near = both.join(least, both["u"] == least["_u"])
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return saved(out.where("u <> v").distinct(), "stars-edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) as (u, v): every vertex u that is not the least of its component, with the least, v.

    Each round is a few joins of rows of two numbers; the number of rounds grows with the logarithm of the
    longest path. Loops and repeated edges do not matter. No edges give no rows.
    """
    now = saved(edges.where("u <> v").select("u", "v").distinct(), "components")
    for _ in range(rounds):
        if _settled(now):
            return now
        now = _stars(_stars(now, True), False)
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around lesser vertices: each u once, and no vertex both u and v."""
    kinds = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = kinds.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b"))
    return edges.where("u < v").isEmpty() and each.where("a > 1 or (a > 0 and b > 0)").isEmpty()
