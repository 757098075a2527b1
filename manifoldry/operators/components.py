"""Connected components by alternating large and small stars, each round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.sources.store import settled


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).head()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in `edges` (a, b): the least id that can be reached. Loops and repeated edges do no harm.

    A star's centre may have any number of neighbours: minima are partial sums before the shuffle, and the join that
    follows is one that Spark can split by itself.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Edges lead from the greater to the smaller end: all of a node's are smaller neighbours.
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(down, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = settled(small.unionByName(down.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
