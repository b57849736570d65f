"""Seeded samples and train/validation/test splits.

A split by rank would put a whole class into one ordered task. Here rank is only
needed around one cut-off: rows are counted per bucket of their random order, the
bucket holding the cut is ordered, and the cut point then is a plain comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.schemas import FEATURES_20
from scoutlake.session import checked_broadcast, small_table, stage


def row_hash(row_id: str, seed: int = 42) -> Column:
    """Random order that is a function of the row id and the seed alone."""
    return F.xxhash64(F.col(row_id), F.lit(int(seed)))


def cut_points(
    df: DataFrame, group: str, row_id: str, order: Column, quota: Column,
    bucket: Column | None = None, limit: int = 2_000_000,
) -> DataFrame:
    """(group, _cut): the (order, id) of the last row within ``quota`` of its group.

    ``quota`` is written over ``n``, the rows of the group. Groups with quota 0 get no
    row. ``bucket`` must not decrease with ``order``; the default suits 64-bit hashes.
    A bucket of more than ``limit`` rows (many rows of one instant) is range-partitioned
    by (order, id) instead of being ordered in one task.
    """
    bucket = F.shiftright(order, 44) if bucket is None else bucket
    keyed = df.select(
        F.col(group), F.struct(order.alias("o"), F.col(row_id).alias("i")).alias("_at"),
        bucket.alias("_bucket"),
    )
    sizes = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy(group).orderBy("_bucket")
    whole = Window.partitionBy(group)
    crossing = (
        sizes.withColumn("upto", F.sum("c").over(along))
        .withColumn("n", F.sum("c").over(whole))
        .withColumn("quota", F.least(F.col("n"), quota.cast("bigint")))
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota")))
        .select(group, "_bucket", "c", (F.col("quota") - F.col("upto") + F.col("c")).alias("take"))
    )
    crossing = small_table(crossing)
    near = keyed.join(crossing, [group, "_bucket"]).drop("_bucket")
    if crossing.filter(F.col("c") > limit).limit(1).count() > 0:
        near = _range_part(near, group, limit)
    else:
        near = near.withColumn("_part", F.lit(0))
    inside = Window.partitionBy(group, "_part").orderBy("_at")
    return (
        near.withColumn("rank", F.row_number().over(inside))
        .filter(F.col("rank") == F.col("take"))
        .select(group, F.col("_at").alias("_cut"))
    )


def _range_part(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """The range partition of each group that holds its ``take``-th row, with ``take``
    counted from the start of that partition."""
    pieces = max(2, int(rows.count() // max(limit // 2, 1)) + 1)
    placed = rows.repartitionByRange(pieces, group, "_at").withColumn("_part", F.spark_partition_id())
    # Staged, because partition numbers must be the same for the counts and the rows.
    placed = stage(placed, "range-parts")
    along = Window.partitionBy(group).orderBy("_part")
    sizes = placed.groupBy(group, "_part", "take").agg(F.count(F.lit(1)).alias("_c"))
    holds = (
        sizes.withColumn("_upto", F.sum("_c").over(along))
        .filter((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_c") < F.col("take")))
        .select(group, "_part", (F.col("take") - F.col("_upto") + F.col("_c")).alias("_left"))
    )
    kept = placed.join(small_table(holds), [group, "_part"])
    return kept.withColumn("take", F.col("_left")).drop("_left")


def within_quota(
    df: DataFrame,
    group: str,
    row_id: str,
    order: Column,
    quota: Column,
    flag: str,
    bucket: Column | None = None,
) -> DataFrame:
    """``df`` with a boolean ``flag``: among the first ``quota`` rows of the group."""
    cuts = cut_points(df, group, row_id, order, quota, bucket)
    at = F.struct(order.alias("o"), F.col(row_id).alias("i"))
    return (
        df.join(small_table(cuts), group, "left")
        .withColumn(flag, F.coalesce(at <= F.col("_cut"), F.lit(False)))
        .drop("_cut")
    )


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    fraction: float,
    order: Column | None = None,
    bucket: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """Adds ``held_out``: true for round(fraction * n) random rows of every class."""
    quota = F.round(F.col("n") * F.lit(float(fraction)))
    return within_quota(
        df, label, row_id, row_hash(row_id, seed) if order is None else order, quota, "held_out", bucket
    )


def per_class_sample(
    df: DataFrame,
    label: str,
    n: int,
    row_id: str,
    order: Column | None = None,
    bucket: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """At most ``n`` random rows of every class."""
    order = row_hash(row_id, seed) if order is None else order
    kept = within_quota(df, label, row_id, order, F.lit(int(n)), "_kept", bucket)
    return kept.filter("_kept").drop("_kept")


def temporal_split(
    df: DataFrame, ts: str, row_id: str, train: float = 0.7, val: float = 0.1, grain: float = 1.0
) -> DataFrame:
    """Adds ``subset`` by time order: the first 70 % train, the next 10 % val, the rest
    test. ``grain`` is the bucket width of ``ts`` used to find the two cut-offs."""
    one = df.withColumn("_all", F.lit(1))
    bucket = F.floor(F.col(ts) / F.lit(grain))
    n = F.col("n")
    first = F.floor(n * F.lit(train))
    second = first + F.floor(n * F.lit(val))
    marked = within_quota(one, "_all", row_id, F.col(ts), first, "_train", bucket)
    marked = within_quota(marked, "_all", row_id, F.col(ts), second, "_early", bucket)
    subset = F.when(F.col("_train"), "train").when(F.col("_early"), "val").otherwise("test")
    return marked.withColumn("subset", subset).drop("_all", "_train", "_early")


def host_split(df: DataFrame, held_out: DataFrame, host: str = "src_ip") -> DataFrame:
    """Adds ``subset``: test for the listed hosts, train for all others."""
    listed = checked_broadcast(held_out.select(host).distinct())
    test = df.join(listed, host, "left_semi").withColumn("subset", F.lit("test"))
    rest = df.join(listed, host, "left_anti").withColumn("subset", F.lit("train"))
    return rest.unionByName(test)


def three_way(
    pool: DataFrame, test: DataFrame, label: str, row_id: str, strategy: str,
    val_fraction: float, drop_fraction: float = 0.0, order: Column | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """train/val from ``pool`` by label, test from another corpus, as one table.

    ``drop_fraction`` leaves that share of the pool out altogether.
    """
    order = row_hash(row_id) if order is None else order
    n = F.col("n")
    outer = F.round(n * F.lit(val_fraction + drop_fraction))
    inner = F.round(n * F.lit(val_fraction))
    marked = within_quota(pool, label, row_id, order, outer, "_outer", bucket)
    marked = within_quota(marked, label, row_id, order, inner, "_val", bucket)
    subset = F.when(F.col("_val"), "val").when(~F.col("_outer"), "train")
    chosen = marked.withColumn("subset", subset).filter("subset IS NOT NULL")
    both = chosen.drop("_outer", "_val").unionByName(test.withColumn("subset", F.lit("test")))
    return both.withColumn("strategy", F.lit(strategy))


def verify_split(split: DataFrame, label: str = "label") -> DataFrame:
    """Class counts per (strategy, subset); raises if a subset lacks a class."""
    counts = split.groupBy("strategy", "subset").agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("recon")
    )
    lacking = counts.filter("benign = 0 OR recon = 0").collect()
    if lacking:
        names = sorted(f"{r['strategy']}/{r['subset']}" for r in lacking)
        raise ValueError("both classes are needed in: " + ", ".join(names))
    return counts


def split_statistics(
    split: DataFrame, features: list[str] | None = None, keys: tuple[str, ...] = ("strategy", "subset")
) -> DataFrame:
    """Rows, class balance, repeated feature rows and missing values per subset."""
    features = features or FEATURES_20
    missing = sum((F.col(c).isNull() | F.isnan(c)).cast("int") for c in features)
    rows = split.withColumn("_nulls", missing)
    per_vector = rows.groupBy(*keys, *features).agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("label") == 0).alias("b"),
        F.count_if(F.col("label") == 1).alias("r"),
        F.sum("_nulls").alias("m"),
    )
    return per_vector.groupBy(*keys).agg(
        F.sum("c").alias("total"),
        F.sum("b").alias("benign"),
        F.sum("r").alias("recon"),
        F.round(F.sum("r") / F.nullif(F.sum("b"), F.lit(0)), 3).alias("class_balance_ratio"),
        (F.sum("c") - F.count(F.lit(1))).alias("duplicate_feature_rows"),
        F.sum("m").alias("missing_values"),
    )


def cap_duplicates(df: DataFrame, names: list[str], row_id: str, cap: int | None) -> DataFrame:
    """The first ``cap`` rows of every identical vector.

    Spark limits each map task to ``cap`` rows per vector before the shuffle, so a
    vector that makes up a third of the table stays cheap. A cap of 1 is a minimum.
    """
    if cap is None:
        return df
    order = Window.partitionBy(*names).orderBy(row_id)
    ranked = df.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= cap).drop("_rank")


def shuffled(df: DataFrame, row_id: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    return df.orderBy(row_hash(row_id, seed) if order is None else order, row_id)


def random_rows(
    df: DataFrame, n: int, row_id: str, seed: int = 42, order: Column | None = None
) -> DataFrame:
    return shuffled(df, row_id, seed, order).limit(n)
