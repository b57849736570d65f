"""Exact classification and ranking metrics as aggregates over a predictions table.

Predictions have key columns (for example strategy, model, seed) and ``label``,
``prediction``, ``score``. Everything is a group-by of counts. Ranking metrics need
running counts over scores; those are made per range of scores with offsets. The ranges
are cut at quantiles of each run's distinct scores, so no task orders a whole run, however
closely its scores stand together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions.exprs import logistic, ratio0
from scoutlake.session import checked_broadcast, stage

# Cut points of a run lie in BLOCKS blocks of BLOCKS, so a score finds its range in two
# short steps. A run of few distinct scores has fewer cuts: one for RANGE_ROWS of them.
BLOCKS = 32
RANGE_ROWS = 65536


def confusion(predictions: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn per key."""
    w = F.lit(1) if weight is None else weight

    def cell(label: int, prediction: int) -> Column:
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, w)), F.lit(0))

    return predictions.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn")
    )


def rates(cells: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 and mcc; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ["tp", "fp", "tn", "fn"])
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return cells.withColumns(
        {
            "accuracy": ratio0(tp + tn, tp + fp + tn + fn),
            "precision": ratio0(tp, tp + fp),
            "recall": ratio0(tp, tp + fn),
            "f1": ratio0(2 * tp, 2 * tp + fp + fn),
            "mcc": ratio0(tp * tn - fp * fn, F.sqrt(margins)),
        }
    )


def score_cuts(tied: DataFrame, keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, cuts, ends): ascending scores that cut a run into ranges of about
    ``range_rows`` distinct scores, or into BLOCKS * BLOCKS equal ranges where that is
    fewer; ``ends`` is the last cut of every whole block.

    ``tied`` has one row per (keys, distinct score). The quantiles are sketches of bounded
    size; they only choose the cuts, so their error moves rows between tasks and changes
    no count.
    """
    ranges = BLOCKS * BLOCKS
    shares = [k / ranges for k in range(1, ranges)]
    rough = tied.groupBy(*keys).agg(
        F.percentile_approx("score", shares, 10 * ranges).alias("_all"), F.count("score").alias("_n")
    )
    step = F.greatest(F.lit(1), F.ceil(F.lit(float(ranges) * range_rows) / F.col("_n"))).cast("long")
    thinned = F.filter(F.coalesce("_all", F.array().cast("array<double>")), lambda x, k: (k + 1) % step == 0)
    cuts = rough.select(*keys, F.array_distinct(thinned).alias("cuts"))
    return cuts.withColumn("ends", F.filter("cuts", lambda x, k: k % BLOCKS == BLOCKS - 1))


def _range_of(score: Column) -> Column:
    """Number of ``cuts`` below a score; 0 for null, which ranks lowest."""
    whole = F.size(F.filter("ends", lambda x: x < score))
    rest = F.slice("cuts", whole * BLOCKS + 1, F.lit(BLOCKS))
    return whole * BLOCKS + F.size(F.filter(rest, lambda x: x < score))


def running_counts(predictions: DataFrame, keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per (keys, distinct score): pos, neg, and the counts strictly above
    (``pos_above``, ``neg_above``) plus totals (``pos_all``, ``neg_all``).

    The cuts are written once: both uses below, and any task that runs again, see the same.
    """
    tied = predictions.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    cuts = checked_broadcast(stage(score_cuts(tied, keys, range_rows), "score-cuts"), 2000)
    tied = tied.join(cuts, keys).withColumn("_range", _range_of(F.col("score"))).drop("cuts", "ends")
    sizes = tied.groupBy(*keys, "_range").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    whole = Window.partitionBy(*keys)
    higher = whole.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("op"),
        F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("on"),
        F.sum("bp").over(whole).alias("pos_all"),
        F.sum("bn").over(whole).alias("neg_all"),
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        tied.join(offsets, [*keys, "_range"])
        .withColumn("pos_above", F.col("op") + F.coalesce(F.sum("pos").over(inside), F.lit(0)))
        .withColumn("neg_above", F.col("on") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
        .drop("_range", "op", "on")
    )


def ranking(counts: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc (ties count one half) and pr_auc (average precision), null when a run
    has one class only."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    p_all, n_all = F.col("pos_all").cast("double"), F.col("neg_all").cast("double")
    neg_below = n_all - F.col("neg_above") - neg
    wins = pos * (neg_below + neg / 2.0)
    tp = F.col("pos_above") + pos
    step = pos * tp / (tp + F.col("neg_above") + neg)
    both = (F.max("pos_all") > 0) & (F.max("neg_all") > 0)
    pairs = F.max(p_all * n_all)
    return counts.groupBy(*keys).agg(
        F.when(both, F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
        F.when(both, F.sum(step) / F.nullif(F.max(p_all), F.lit(0.0))).alias("pr_auc"),
    )


def roc_points(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, fpr, tpr), one point per distinct score, plus the origin."""
    tpr = (F.col("pos_above") + F.col("pos")) / F.nullif(F.col("pos_all"), F.lit(0))
    fpr = (F.col("neg_above") + F.col("neg")) / F.nullif(F.col("neg_all"), F.lit(0))
    points = counts.select(*keys, F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    origin = counts.select(*keys).distinct().select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_trapezoid(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC points. A step of one score adds a trapezoid of its own
    counts, so no ordering is needed once the running counts exist."""
    height = F.col("pos_above") + F.col("pos") / 2.0
    area = F.sum(F.col("neg") * height) / F.nullif(F.max(F.col("pos_all") * F.col("neg_all")), F.lit(0))
    return counts.groupBy(*keys).agg(area.alias("auc"))


def pr_points(counts: DataFrame, keys: list[str]) -> DataFrame:
    tp = F.col("pos_above") + F.col("pos")
    return counts.select(
        *keys,
        F.col("score").alias("threshold"),
        ratio0(tp, F.col("pos_all")).alias("recall"),
        ratio0(tp, tp + F.col("neg_above") + F.col("neg")).alias("precision"),
    )


def pr_trapezoid(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area under the precision-recall points, beginning at (0, 1)."""
    tp_before = F.col("pos_above").cast("double")
    seen_before = tp_before + F.col("neg_above")
    tp = tp_before + F.col("pos")
    seen = seen_before + F.col("pos") + F.col("neg")
    before = F.when(seen_before > 0, tp_before / F.nullif(seen_before, F.lit(0.0))).otherwise(F.lit(1.0))
    slab = F.col("pos") * (before + tp / seen) / 2.0
    area = F.sum(slab) / F.nullif(F.max("pos_all"), F.lit(0))
    return counts.groupBy(*keys).agg(area.alias("auc"))


def evaluate(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics per key, with the size of the test set."""
    simple = rates(confusion(predictions, keys))
    ranked = ranking(running_counts(predictions, keys), keys)
    sized = simple.withColumn("n_test", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return sized.join(ranked, keys)


def score_column(probability: str | None = None, decision: str | None = None) -> Column:
    """Higher means more attack-like: a positive-class probability, or the logistic of
    the negated decision value of a model whose anomalies are negative."""
    if probability is not None:
        return F.col(probability)
    return logistic(-F.col(decision))


def reconcile(computed: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Recomputed against stored ``roc_auc``."""
    both = computed.select(*keys, F.col("roc_auc").alias("computed")).join(
        stored.select(*keys, F.col("roc_auc").alias("stored")), keys
    )
    gap = F.abs(F.col("computed") - F.col("stored"))
    return both.withColumns({"difference": gap, "agrees": F.coalesce(gap <= tolerance, F.lit(True))})


def per_subtype(predictions: DataFrame, keys: list[str], subtype: str = "attack_type") -> DataFrame:
    return rates(confusion(predictions, [*keys, subtype]))


def class_report(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1, support for each class, and their macro and weighted means."""
    cells = confusion(predictions, keys)

    def view(name: str, tp: str, fp: str, fn: str) -> Column:
        hit, false, miss = F.col(tp), F.col(fp), F.col(fn)
        return F.struct(
            F.lit(name).alias("class"),
            ratio0(hit, hit + false).alias("precision"),
            ratio0(hit, hit + miss).alias("recall"),
            ratio0(2 * hit, 2 * hit + false + miss).alias("f1"),
            (hit + miss).alias("support"),
        )

    sides = F.array(view("0", "tn", "fn", "fp"), view("1", "tp", "fp", "fn"))
    per_class = cells.select(*keys, F.explode(sides).alias("v")).select(*keys, "v.*")
    names = ["precision", "recall", "f1"]
    support = F.col("support")
    macro = per_class.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names], F.sum(support).alias("support"))
    weighted = per_class.groupBy(*keys).agg(
        *[ratio0(F.sum(F.col(n) * support), F.sum(support)).alias(n) for n in names],
        F.sum(support).alias("support"),
    )
    return per_class.unionByName(
        macro.withColumn("class", F.lit("macro avg"))
    ).unionByName(weighted.withColumn("class", F.lit("weighted avg")))


def class_scores(predictions: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Mean score and number of distinct feature vectors per class."""
    vectors = predictions.groupBy(*keys, "label", *features).agg(
        F.sum("score").alias("s"), F.count(F.lit(1)).alias("c")
    )
    return vectors.groupBy(*keys, "label").agg(
        (F.sum("s") / F.sum("c")).alias("mean_score"),
        F.sum("c").alias("rows"),
        F.count(F.lit(1)).alias("distinct_vectors"),
    )
