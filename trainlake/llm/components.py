"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every id in ``links``; the component is its smallest id.

    In each round every vertex joins the neighbour (or itself) that comes first in a random
    order made anew for the round, and the links are rewritten to the joined vertices. Joined
    vertices stay connected, links within one vertex vanish, and a star or a chain shrinks to a
    fraction in each round. All tables are written; none passes through the driver.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    start = written(links.filter("u <> v").distinct(), "links")
    current, vertices, turn = start, None, 0
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = F.xxhash64(F.lit(turn), F.col("v"))
        nearest = both.groupBy("u").agg(F.min_by("v", rank).alias("id"), F.min(rank).alias("rank"))
        joined = written(nearest.select("u", F.when(F.xxhash64(F.lit(turn), F.col("u")) <= F.col("rank"), F.col("u")).otherwise(F.col("id")).alias("to")), "joined")
        if vertices is None:
            vertices = joined.select(F.col("u").alias("id"), F.col("to").alias("root"))
        else:
            moved = vertices.join(joined, vertices["root"] == joined["u"], "left")
            vertices = moved.select("id", F.coalesce("to", "root").alias("root"))
        vertices = written(vertices, "roots")
        left = current.join(joined, "u").select(F.col("to").alias("u"), "v")
        right = left.join(joined.select(F.col("u").alias("v"), "to"), "v").select("u", F.col("to").alias("v"))
        ordered = right.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        current = written(ordered.distinct(), "links")
        turn += 1
    if vertices is None:
        kind = dict(links.dtypes)["u"]
        return links.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    smallest = vertices.groupBy("root").agg(F.min("id").alias("component"))
    return vertices.join(smallest, "root").select("id", "component")
