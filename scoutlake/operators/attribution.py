"""Shapley attributions by permutation sampling, as one batch scoring job.

For a row x, a background row z and an order of the features, features are switched
from z to x one after the other; the change of the score at a switch belongs to that
feature. Every switch state is one synthetic row, all scored together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shapley(
    rows: DataFrame, background: DataFrame, features: list[str], row_id: str,
    score: Callable[[DataFrame], DataFrame], permutations: int = 50, seed: int = 42,
    background_rows: int = 50,
) -> DataFrame:
    """(row_id, feature, value): attribution of the positive-class score.

    ``rows`` are the sampled rows to explain; ``background`` is thinned to
    ``background_rows`` by hash, which the permutations take in turn. ``score`` adds a column ``score`` to feature columns.
    """
    names = F.array(*[F.lit(f) for f in features])
    order = F.xxhash64(row_id, F.lit(seed))
    base = (
        background.orderBy(order, row_id)
        .limit(background_rows)
        .select(F.struct(*features).alias("z"), F.row_number().over(Window.orderBy(order, row_id)).alias("back"))
    )

    def sort_key(name):
        return F.struct(F.xxhash64(F.col("perm"), F.lit(seed), name).alias("h"), name.alias("f"))

    shuffled = F.transform(F.array_sort(F.transform(names, sort_key)), lambda s: s["f"])
    # One row per explained row and permutation.
    pairs = (
        rows.select(row_id, F.struct(*features).alias("x"))
        .withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .withColumn("back", (F.col("perm") - 1) % F.lit(max(base.count(), 1)) + 1)
        .join(F.broadcast(base), "back")
        .withColumn("order", shuffled)
    )
    states = pairs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    switched = {
        f: F.when(F.array_position("order", f) <= F.col("pos"), F.col(f"x.{f}")).otherwise(F.col(f"z.{f}"))
        for f in features
    }
    synthetic = states.select(
        row_id, "perm", "pos", F.try_element_at("order", F.nullif("pos", F.lit(0))).alias("feature"),
        *[c.alias(f) for f, c in switched.items()],
    )
    scored = score(synthetic)
    path = Window.partitionBy(row_id, "perm").orderBy("pos")
    steps = scored.withColumn("value", F.col("score") - F.lag("score").over(path)).filter("pos > 0")
    return steps.groupBy(row_id, "feature").agg(F.avg("value").alias("value"))
