"""Inter-arrival statistics of rows in time order, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_gap_stats(parts: str, n: str, mean: str, m2: str, edge: str) -> tuple[Column, Column]:
    """(mean, population variance) of gaps merged from per-part moments.

    Every part carries (n, mean, m2) of the gaps inside it and ``edge``, the gap to
    the part before it (null for the first). ``parts`` is any never-null column.
    """
    edge_n = F.count(edge)
    gaps = F.sum(n) + edge_n
    mass = F.sum(F.col(n) * F.coalesce(F.col(mean), F.lit(0.0))) + F.coalesce(
        F.sum(edge), F.lit(0.0)
    )
    merged_mean = mass / F.nullif(gaps, F.lit(0))
    squares = F.sum(
        F.coalesce(F.col(m2), F.lit(0.0))
        + F.col(n) * F.coalesce(F.col(mean) * F.col(mean), F.lit(0.0))
        + F.coalesce(F.col(edge) * F.col(edge), F.lit(0.0))
    )
    merged_m2 = F.when(F.count(parts) == 1, F.sum(m2)).otherwise(
        squares - gaps * merged_mean * merged_mean
    )
    merged_var = F.greatest(F.lit(0.0), merged_m2 / F.nullif(gaps, F.lit(0)))
    return F.coalesce(merged_mean, F.lit(0.0)), F.coalesce(merged_var, F.lit(0.0))


def sorted_gap_moments(rows: DataFrame, keys: list[str], ts: str, bucket_s: float) -> DataFrame:
    """Mean and population variance of successive differences of sorted timestamps.

    A key is cut into time buckets, so no task sorts more than one bucket of one
    key; the bucket summaries (first, last, gap moments) are then chained per key.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(ts) / F.lit(float(bucket_s))))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    pieces = (
        bucketed.withColumn("_gap", F.col(ts) - F.lag(ts).over(inside))
        .groupBy(*keys, "_bucket")
        .agg(
            F.count("_gap").alias("_n"),
            F.avg("_gap").alias("_mean"),
            (F.var_pop("_gap") * F.count("_gap")).alias("_m2"),
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
        )
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    chained = pieces.withColumn("_edge", F.col("_first") - F.lag("_last").over(across))
    mean, var = merged_gap_stats("_bucket", "_n", "_mean", "_m2", "_edge")
    return chained.groupBy(*keys).agg(mean.alias("gap_mean"), var.alias("gap_var"))
