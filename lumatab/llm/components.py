"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Each round points every node's larger neighbours, then its smaller ones, at the smallest neighbour known;
the number of rounds grows with the logarithm of the longest chain. Rounds are cut with tables in the shared
folder. Joins have plain exchanges on both sides, so that a hub's edges can be split over tasks; minima are
added up before they are shuffled. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatab.llm import shared


def connected_components(edges: DataFrame, tables: shared.Steps, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a, b), any orderable type; component is the smallest node reachable. It reads a table that goes with the others of `tables`."""
    spark = edges.sparkSession
    pairs, at = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, at1 = shared.written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
        large, at2 = shared.written(both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, at3 = shared.written(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "small-star")
        for path in (at, at1, at2):
            shared.drop(spark, path)
        at, last, state = at3, state, _state(pairs)
        if state == last:
            tables.paths["components"] = at
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
