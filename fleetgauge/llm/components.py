"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import keep


def _least_neighbour(both: DataFrame) -> DataFrame:
    """Every (u, v) with the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("least"))
    return both.join(least.hint("shuffle_merge"), "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges point from the larger to the smaller end."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    stars = large.filter("u > v").distinct()
    small = _least_neighbour(stars)
    moved = small.filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(small.select("u", F.col("least").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of one edge only to a least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node.

    ``edges`` has columns u and v. Large-star and small-star steps are repeated until only
    stars are left; each result is a table in the shared folder.
    """
    now = keep(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while not _are_stars(now):
        now = keep(_round(now))
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
