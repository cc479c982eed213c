"""Connected components of a link table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of a link (a, b); the component is its smallest id.

    Each round maps every node to the smallest of itself and its neighbours and replaces each link by one
    between these. Nodes are aggregated by key with partial sums on the map side, so a node with very many
    links does no more than its share. Links shrink until none is left; the maps are then chained.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    maps = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("a").alias("to")).unionByName(
            edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        step = stored(ends.groupBy("id").agg(F.min("to").alias("to")))
        maps.append(step)
        left = step.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        right = step.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").where("to_a != to_b")
        edges = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps.pop().select("id", F.col("to").alias("component"))
    while maps:
        step, after = maps.pop(), out.select(F.col("id").alias("to"), "component")
        out = step.join(after, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return stored(out)
