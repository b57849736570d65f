"""Comparing models over seeds: summaries and non-parametric tests.

Inputs are metric tables in long form (strategy, model, seed, metric, value), or
predictions for McNemar. Pairing is always by seed or row id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions.exprs import ratio0
from scoutlake.functions.pvalues import chi2_p, signed_rank_p
from scoutlake.operators.metrics import confusion

RUN = ["strategy", "model", "seed"]


def to_long(metrics: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    keys = keys or RUN
    wide = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(keys, names, "metric", "value").filter("value IS NOT NULL")


def seed_summary(long: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds (0 for one seed)."""
    return long.groupBy("strategy", "model", "metric").agg(
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("std"),
        F.count("value").alias("n_seeds"),
    )


def _average_rank(value: Column, keys: list[str]) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def _paired(long: DataFrame, min_seeds: int) -> DataFrame:
    """Models with enough seeds, and only the seeds all of them have."""
    block = ["strategy", "metric"]
    seeds = Window.partitionBy(*block, "model")
    enough = long.withColumn("_n", F.count("value").over(seeds)).filter(F.col("_n") >= min_seeds)
    models = enough.groupBy(*block).agg(F.countDistinct("model").alias("k"))
    shared = enough.groupBy(*block, "seed").agg(F.count("value").alias("c"))
    return (
        enough.join(models, block)
        .join(shared, [*block, "seed"])
        .filter(F.col("c") == F.col("k"))
        .drop("_n", "c")
    )


def friedman(long: DataFrame, min_models: int = 3, min_seeds: int = 3) -> DataFrame:
    """Tie-corrected Friedman test of the models of every (strategy, metric)."""
    block = ["strategy", "metric"]
    paired = _paired(long, min_seeds).filter(F.col("k") >= min_models)
    ranked = paired.withColumn("rank", _average_rank(F.col("value"), [*block, "seed"]))
    per_model = ranked.groupBy(*block, "k", "model").agg(
        F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n")
    )
    tied = (
        ranked.groupBy(*block, "seed", "value")
        .agg(F.count(F.lit(1)).alias("t"))
        .groupBy(*block)
        .agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    )
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    spread = per_model.groupBy(*block, "k").agg(
        F.sum(F.col("r") * F.col("r")).alias("ss"), F.max("n").alias("n")
    )
    plain = F.lit(12.0) / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    correction = F.lit(1.0) - F.col("ties") / (n * k * (k * k - 1))
    return (
        spread.join(tied, block)
        .withColumn("statistic", plain / F.nullif(correction, F.lit(0.0)))
        .withColumn("p_value", chi2_p("statistic", F.col("k") - 1))
        .select(
            *block,
            F.col("k").alias("models"),
            F.col("n").alias("seeds"),
            "statistic",
            "p_value",
            (F.col("p_value") < 0.05).alias("significant_005"),
        )
    )


def wilcoxon(long: DataFrame, min_seeds: int = 3) -> DataFrame:
    """Signed-rank test of every model pair, paired by seed, Bonferroni-corrected.

    ``attainable_p`` is the smallest corrected p the number of seeds allows at all.
    """
    block = ["strategy", "metric"]
    rows = _paired(long, min_seeds).select(*block, "k", "seed", "model", "value")
    a = rows.select(*block, "k", "seed", F.col("model").alias("model_a"), F.col("value").alias("va"))
    b = rows.select(*block, "seed", F.col("model").alias("model_b"), F.col("value").alias("vb"))
    pair = [*block, "model_a", "model_b"]
    diffs = (
        a.join(b, [*block, "seed"])
        .filter(F.col("model_a") < F.col("model_b"))
        .withColumn("d", F.round(F.col("va") - F.col("vb"), 12))
    )
    moved = diffs.filter("d <> 0").withColumn("rank", _average_rank(F.abs("d"), pair))
    sums = moved.groupBy(*pair).agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0)).alias("w_minus"),
        F.array_sort(F.collect_list("rank")).alias("ranks"),
    )
    pairs = diffs.groupBy(*pair).agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("seeds"))
    times = F.col("k") * (F.col("k") - 1) / 2
    none = F.array().cast("array<double>")
    return (
        pairs.join(sums, pair, "left")
        .withColumn("ranks", F.coalesce("ranks", none))
        .withColumn("statistic", F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)))
        .withColumn("p_value", signed_rank_p("ranks", "statistic"))
        .withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * times))
        .withColumn("attainable_p", F.least(F.lit(1.0), F.pow(F.lit(2.0), 1 - F.col("seeds")) * times))
        .withColumn("significant_005", F.col("p_bonferroni") < 0.05)
        .drop("ranks", "w_plus", "w_minus", "k")
    )


def mcnemar(predictions: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Continuity-corrected McNemar test of all model pairs per ``keys``.

    Rows meet once per row id as an array of models (one entry per model, so the array
    is as short as the list of models), and pairs are counted from it: one shuffle of
    the predictions and no self-join.
    """
    right = (F.col("prediction") == F.col("label")).alias("right")
    per_row = predictions.groupBy(*keys, row_id).agg(
        F.array_sort(F.collect_set(F.struct("model", right))).alias("m")
    )

    def with_later(left, i):
        return F.transform(
            F.slice(F.col("m"), i + 2, F.size("m")), lambda later: F.struct(left.alias("a"), later.alias("b"))
        )

    pairs = F.flatten(F.transform("m", with_later))
    split = per_row.select(*keys, F.explode(pairs).alias("p")).groupBy(
        *keys, F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b")
    )
    counts = split.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p.a.right") & ~F.col("p.b.right")).alias("b"),
        F.count_if(~F.col("p.a.right") & F.col("p.b.right")).alias("c"),
    )
    return with_mcnemar_p(counts)


def with_mcnemar_p(counts: DataFrame) -> DataFrame:
    off = F.col("b") + F.col("c")
    edge = F.abs(F.col("b") - F.col("c")) - 1
    return counts.withColumn("chi2", ratio0(edge * edge, off)).withColumn(
        "p_value", F.when(off > 0, chi2_p("chi2", F.lit(1))).otherwise(F.lit(1.0))
    )


def pooled_mcnemar(predictions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """McNemar over all seeds together per strategy, Bonferroni over the pairs."""
    per_seed = mcnemar(predictions, ["strategy", "seed"], row_id)
    pooled = per_seed.groupBy("strategy", "model_a", "model_b").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("c").alias("c")
    )
    pairs = F.count(F.lit(1)).over(Window.partitionBy("strategy"))
    return (
        with_mcnemar_p(pooled)
        .withColumn("p_corrected", F.least(F.lit(1.0), F.col("p_value") * pairs))
        .withColumn("significant", F.col("p_corrected") < 0.05)
    )


def bootstrap_interval(
    predictions: DataFrame, keys: list[str], replicates: int = 1000, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile intervals of f1 and mcc.

    Resampling rows with replacement draws the four confusion cells from a multinomial,
    so only the counts are resampled, however many predictions there are.
    """
    cells = confusion(predictions, keys)
    kinds = {f.name: f for f in cells.schema.fields}
    fields = ", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in keys)

    def resample(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                counts = np.array([row.tp, row.fp, row.tn, row.fn], dtype=float)
                n = int(counts.sum())
                rng = np.random.default_rng([seed, *[int(c) for c in counts]])
                draws = rng.multinomial(n, counts / max(n, 1), size=replicates) if n else np.zeros((1, 4))
                tp, fp, tn, fn = draws.T.astype(float)
                f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros_like(tp), where=(2 * tp + fp + fn) > 0)
                root = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
                mcc = np.divide(tp * tn - fp * fn, root, out=np.zeros_like(tp), where=root > 0)
                if not ((f1 >= 0) & (f1 <= 1)).all() or not (np.abs(mcc) <= 1 + 1e-9).all():
                    raise ValueError("metric outside its bounds")
                edge = (1 - level) / 2
                bounds = [np.quantile(v, [edge, 1 - edge]) for v in (f1, mcc)]
                out.append([*(getattr(row, k) for k in keys), *bounds[0], *bounds[1]])
            yield pd.DataFrame(out, columns=[*keys, "f1_low", "f1_high", "mcc_low", "mcc_high"])

    schema = f"{fields}, f1_low double, f1_high double, mcc_low double, mcc_high double"
    return cells.mapInPandas(resample, schema)


def best_models(long: DataFrame, metric: str = "f1") -> DataFrame:
    """Best model per strategy by mean, and its seed closest to that mean."""
    rows = long.filter(F.col("metric") == metric)
    means = rows.groupBy("strategy", "model").agg(F.round(F.avg("value"), 12).alias("mean"))
    order = Window.partitionBy("strategy").orderBy(F.col("mean").desc(), "model")
    best = means.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    near = F.round(F.abs(F.col("value") - F.col("mean")), 12)
    return (
        rows.join(best, ["strategy", "model"])
        .groupBy("strategy", "model", "mean")
        .agg(F.min_by("seed", F.struct(near, F.col("seed"))).alias("seed"))
    )


def metric_matrix(long: DataFrame, metric: str, models: list[str]) -> DataFrame:
    return (
        long.filter(F.col("metric") == metric).groupBy("strategy").pivot("model", models).agg(F.avg("value"))
    )


def summed_confusion(cells: DataFrame) -> DataFrame:
    return cells.groupBy("strategy", "model").agg(*[F.sum(c).alias(c) for c in ["tn", "fp", "fn", "tp"]])


def same_test_set(metrics: DataFrame) -> DataFrame:
    """Distinct test sets behind every strategy's runs; comparisons need exactly one."""
    return (
        metrics.groupBy("strategy")
        .agg(F.countDistinct("test_set_id", "n_test").alias("test_sets"))
        .withColumn("comparable", F.col("test_sets") == 1)
    )


def attribution_ranking(values: DataFrame, n: int = 20) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
        .limit(n)
    )


def importance_share(importances: DataFrame, prefix: str = "host_") -> DataFrame:
    """Sum of importances over features whose name begins with ``prefix``, per seed."""
    return (
        importances.filter(F.col("feature").startswith(prefix))
        .groupBy("seed")
        .agg(F.sum("importance").alias("importance"))
    )
