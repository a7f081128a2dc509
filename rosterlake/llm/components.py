"""Connected components of an edge table by alternating stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that a link of edges(a, b) ties to another; component is the smallest id reachable.

    Rounds grow with the logarithm of the graph's width. Each round is written to the shared folder, so a lost executor
    costs one round at most. Repeated links are allowed; a link of an id to itself counts for nothing; an empty table gives an empty result.
    """
    state = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        sums = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (sums["n"], sums["h"]) or not sums["n"]:
            break
        mark = (sums["n"], sums["h"])
        wider = saved(_small_star(_large_star(state).distinct()).distinct(), "edges")
        discard(state)
        state = wider
    tied = state.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return tied.unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
