"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Each round links every larger neighbour to the least neighbour (large star), then the
    smaller ones (small star). Minima are reduced before the shuffle, so a node with a
    third of all edges costs one row per map task there; the join back is one that Spark
    may split. Rounds are written to the shared folder, which cuts the lineage.
    """
    now = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u > v")
        .distinct(),
        "edges",
    )
    size = _state(now)
    while size[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select("u", F.col("m").alias("v")).unionByName(
            hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = stage(small.where("u > v").distinct(), "edges")
        if (new := _state(now)) == size:
            break
        size = new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return row["n"], int(row["h"])
