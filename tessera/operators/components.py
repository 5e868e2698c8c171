"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import WorkTables, by_key


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node that links lead to.

    Rounds grow with the logarithm of the longest chain; the edge set never grows. Each round is a written table, of which
    the last stays for the result. A node that has a large share of all edges is only ever the smaller side's one row: its
    least neighbour is found by partial aggregates, and Spark may split its edges in the join (adaptive skew joins).
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(by_key(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(by_key(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def stars(e: DataFrame) -> bool:
        """Every node has one edge down, and what that leads to has none: each component hangs on its smallest node."""
        n = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("u")).first()
        return n["n"] == n["u"] and e.join(by_key(e.select(F.col("v").alias("u"))), "u", "left_semi").isEmpty()

    work = WorkTables(edges.sparkSession)
    state = work.written(directed(edges), "edges")
    while not stars(state):
        later = WorkTables(edges.sparkSession)
        state = later.written(small(large(state)), "edges")
        work.drop()
        work = later
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
