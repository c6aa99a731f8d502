"""Connected components by alternating large-star and small-star rounds.

Each round is two min-aggregations, combined before they are shuffled, and two
equi-joins on tables that were written before, so that adaptive execution can split
a hub's rows over tasks. Nothing is gathered on the driver but two numbers a round.
Rounds grow with the logarithm of the longest chain of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def connected_components(edges: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (a long, b long) but the smallest of each
    component, which is the component's name. Loops and repeated edges may occur."""
    state = tables.write(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(state)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        low = tables.write(state.groupBy("u").agg(F.min("v").alias("low")))
        # Large star: each edge's smaller end gives way to its own smallest neighbour.
        large = tables.write(
            state.join(low.withColumnRenamed("u", "w"), F.col("v") == F.col("w"), "left")
            .select("u", F.coalesce("low", "v").alias("v"))
        )
        low2 = tables.write(large.groupBy("u").agg(F.min("v").alias("low")))
        # Small star: all smaller neighbours of a node are tied to the smallest of them.
        small = large.join(low2, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = tables.write(low2.select("u", F.col("low").alias("v")).union(small).distinct())
        now = _mark(after)
        for t in (state, low, large, low2):
            tables.drop(t)
        state, before, mark = after, mark, now
        if before == now:
            break
    else:
        raise RuntimeError("the components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(state: DataFrame) -> tuple:
    row = state.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row.n, row.h
