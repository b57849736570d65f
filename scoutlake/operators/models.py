"""Model families over canonical features: scaling, training, tuning, scoring.

Spark ML does the distributed training; this module fixes the feature order, balanced
weights, one score column per family and model choice by validation F1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.functions.exprs import logistic
from scoutlake.operators import iforest
from scoutlake.operators.detect import rule_verdict
from scoutlake.operators.metrics import confusion, evaluate, rates
from scoutlake.operators.prep import ABLATIONS, ablation_features, flow_only_features
from scoutlake.operators.splits import cap_duplicates
from scoutlake.schemas import FEATURES_20
from scoutlake.session import new_folder, stage

# Fits that run at once, as in Spark's own cross-validation: a fit is a chain of many short
# jobs, which leaves cores idle. Beyond MANY_ROWS training rows, whose bags fill the
# executors' storage, it is two.
FITS_AT_ONCE = 4
MANY_ROWS = 1_000_000


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature is divided by 1."""

    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f: (F.col(f) - F.lit(m)) / F.lit(self.std[f]) for f, m in self.mean.items()}
        )

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, self.mean[f], self.std[f]) for f in self.mean]
        return spark.createDataFrame(rows, "feature string, mean double, std double")


def fit_scaler(train: DataFrame, features: list[str]) -> Scaler:
    aggs = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    row = train.agg(*aggs).first()
    mean = {f: float(row[f"m_{f}"] or 0.0) for f in features}
    std = {f: float(row[f"s_{f}"] or 0.0) or 1.0 for f in features}
    return Scaler(mean, std)


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def balanced_weights(train: DataFrame, label: str = "label") -> Column:
    """n / (classes * n_class), the two class counts as constants."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for value, c in counts.items():
        weight = F.when(F.col(label) == value, F.lit(n / (k * c))).otherwise(weight)
    return weight


@dataclass(frozen=True)
class Family:
    """One model family: its grid, estimator and where its score comes from."""

    grid: list[dict[str, Any]]
    build: Callable[[dict[str, Any], int, int, int], Any] | None
    scaled: bool = False
    weighted: bool = False
    counted: bool = False
    from_margin: bool = False


def _forest(p, seed, width, n):
    # The same trees with and without cached node ids; with them no row walks a tree from
    # its root again for every level.
    return RandomForestClassifier(
        labelCol="label", numTrees=p["trees"], maxDepth=p["depth"], seed=seed, weightCol="weight", cacheNodeIds=True
    )


def _boosted(p, seed, width, n):
    return GBTClassifier(
        labelCol="label", maxDepth=p["depth"], stepSize=p["rate"], maxIter=p["rounds"], seed=seed, weightCol="copies"
    )


def _svm(p, seed, width, n):
    # The penalty C of summed losses as a regularisation of the mean loss.
    penalty = 1.0 / (p["C"] * max(n, 1))
    return LinearSVC(labelCol="label", regParam=penalty, maxIter=p["iterations"], standardization=False)


def _mlp(p, seed, width, n):
    # Rows multiplied at once; the default of 128 spends more on blocks than on products.
    return MultilayerPerceptronClassifier(
        labelCol="label", layers=[width, p["hidden"], 2], maxIter=p["iterations"], seed=seed, blockSize=1024
    )


FAMILIES: dict[str, Family] = {
    "random_forest": Family(
        [{"trees": t, "depth": d} for t in (100, 200) for d in (30, 15)], _forest, weighted=True
    ),
    "xgboost": Family(
        [{"depth": d, "rate": r, "rounds": 100} for d in (5, 7) for r in (0.1, 0.05)], _boosted,
        counted=True,
    ),
    "svm": Family([{"C": c, "iterations": 100} for c in (1.0, 5.0)], _svm, scaled=True, from_margin=True),
    "isolation_forest": Family([{"contamination": 0.1, "trees": 100}], None),
    "mlp": Family([{"hidden": h, "iterations": 200} for h in (100, 200)], _mlp, scaled=True),
}


@dataclass
class Trained:
    name: str
    params: dict[str, Any]
    features: list[str]
    scaler: Scaler | None
    model: Any
    validation_f1: float = 0.0
    from_margin: bool = False
    extra: dict[str, Any] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (higher is more attack-like) and ``prediction`` at one half."""
        if isinstance(self.model, iforest.IsolationForest):
            return self.model.predict(df).drop("anomaly")
        kept = df.columns
        raw = {f: F.col(f).alias(f"_raw_{f}") for f in self.features}
        ready = df.select("*", *raw.values())
        if self.scaler is not None:
            ready = self.scaler.transform(ready)
        out = self.model.transform(vectors(ready, self.features))
        if self.from_margin:
            score = logistic(vector_to_array("rawPrediction")[1])
        else:
            score = vector_to_array("probability")[1]
        named = [F.col(f"_raw_{c}").alias(c) if c in raw else F.col(c) for c in kept]
        return out.select(*named, score.alias("score")).withColumn("prediction", threshold(F.col("score")))


def threshold(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def fits_at_once(train: DataFrame) -> int:
    return FITS_AT_ONCE if train.count() <= MANY_ROWS else 2


def at_once(spark: SparkSession, tasks: list[Callable[[], Any]], parallel: int) -> Iterator[Any]:
    """Results of ``tasks`` in their order, ``parallel`` of them running at a time."""
    run = inheritable_thread_target(spark)
    with ThreadPool(max(1, min(parallel, len(tasks)))) as pool:
        yield from pool.imap(lambda task: task(), [run(task) for task in tasks], 1)


def counted_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Every different (label, features) once, with its number of rows as ``copies``.

    For a family whose loss is a plain sum over rows, without bags, a row that weighs
    ``copies`` adds what its copies add."""
    copies = F.count(F.lit(1)).cast("double").alias("copies")
    return stage(df.groupBy("label", *features).agg(copies), "counted")


def fit_one(
    name: str, params: dict[str, Any], train: DataFrame, features: list[str], seed: int, row_id: str = "row_id"
) -> Trained:
    family = FAMILIES[name]
    if family.build is None:
        forest = iforest.fit(
            train, features, row_id, trees=params["trees"], contamination=params["contamination"], seed=seed
        )
        return Trained(name, params, features, None, forest)
    scaler = fit_scaler(train, features) if family.scaled else None
    ready = scaler.transform(train) if scaler else train
    n = train.count() if family.from_margin else 0
    if family.counted:
        ready = counted_rows(ready, features)
    if family.weighted:
        ready = ready.withColumn("weight", balanced_weights(train))
    model = family.build(params, seed, len(features), n).fit(vectors(ready, features))
    return Trained(name, params, features, scaler, model, from_margin=family.from_margin)


def f1_of(scored: DataFrame) -> float:
    return float(rates(confusion(scored, [])).first()["f1"])


def tune(
    name: str, train: DataFrame, val: DataFrame, seed: int, features: list[str] | None = None,
    grid: list[dict[str, Any]] | None = None, row_id: str = "row_id", parallel: int | None = None,
) -> Trained:
    """Best setting by validation F1; the first of equals wins. All settings are fitted,
    ``parallel`` of them at a time."""

    def fitted(params: dict[str, Any]) -> Trained:
        one = fit_one(name, params, train, features or FEATURES_20, seed, row_id)
        one.validation_f1 = f1_of(one.score(val))
        return one

    tasks = [lambda p=params: fitted(p) for params in grid or FAMILIES[name].grid]
    parallel = parallel or (fits_at_once(train) if len(tasks) > 1 else 1)
    return max(at_once(train.sparkSession, tasks, parallel), key=lambda one: one.validation_f1)


RUN_TABLE = "strategy string, model string, seed int, setting string, validation_f1 double"


def train_grid(
    splits: DataFrame, models: list[str], seeds: list[int], folder: str, features: list[str] | None = None,
    grids: dict[str, list[dict[str, Any]]] | None = None, row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame]:
    """Train every (strategy, model, seed); returns test predictions and the table of runs.

    ``splits`` has strategy, subset, features, label, row_id. It is written once, parted by
    strategy and subset in files of even size, as every run reads its part several times. Every run is a distributed job whose predictions are
    written to a folder of their own below ``folder``; then the run is added to the table of
    runs with its chosen setting. A few runs go on at a time; the table is written by one of
    them after another, in the order of the plan. A grid started again on the same ``folder`` skips the runs
    in that table and overwrites what a lost one left behind.
    """
    spark = splits.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in splits.schema.fields}
    path = new_folder(spark, "splits")
    splits.hint("rebalance", "strategy", "subset").write.partitionBy("strategy", "subset").parquet(path)
    splits = spark.read.schema(splits.schema).parquet(path)
    strategies = sorted(r[0] for r in splits.select("strategy").distinct().collect())
    spark.createDataFrame([], RUN_TABLE).write.mode("append").parquet(f"{folder}/runs")
    runs = spark.read.schema(RUN_TABLE).parquet(f"{folder}/runs")
    done = {(r["strategy"], r["model"], r["seed"]) for r in runs.select("strategy", "model", "seed").collect()}
    plan = [(s, m, k) for s in strategies for m in models for k in seeds if (s, m, k) not in done]

    def one_run(strategy: str, name: str, seed: int) -> list[tuple]:
        mine = splits.filter(F.col("strategy") == strategy)
        train, val, test = (mine.filter(F.col("subset") == s) for s in ("train", "val", "test"))
        best = tune(name, train, val, seed, features, (grids or {}).get(name), row_id, parallel=1)
        path = f"{folder}/predictions/strategy={strategy}/model={name}/seed={seed}"
        best.score(test).select(row_id, "label", "prediction", "score").write.mode("overwrite").parquet(path)
        return [(strategy, name, seed, str(best.params), float(best.validation_f1))]

    most = splits.filter("subset = 'train'").groupBy("strategy").count().agg(F.max("count")).first()[0] or 0
    parallel = FITS_AT_ONCE if most <= MANY_ROWS else 2
    for run in at_once(spark, [lambda r=run: one_run(*r) for run in plan], parallel):
        spark.createDataFrame(run, RUN_TABLE).coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    runs = spark.read.schema(RUN_TABLE).parquet(f"{folder}/runs")
    schema = f"{row_id} {kinds[row_id]}, label {kinds['label']}, prediction int, score double, strategy string, model string, seed int"
    found = spark.read.schema(schema).parquet(f"{folder}/predictions")
    keys = ["strategy", "model", "seed"]
    predictions = found.join(F.broadcast(runs.select(keys)), keys, "left_semi")  # a row per run
    return predictions.select(*keys, row_id, "label", "prediction", "score"), runs


def rule_predictions(features: DataFrame) -> DataFrame:
    """The rules as a model: prediction and confidence as score."""
    verdict = rule_verdict()
    return features.withColumns({"prediction": verdict["prediction"], "score": verdict["confidence"]})


def importances(spark: SparkSession, trained: Trained) -> DataFrame:
    values = trained.model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(trained.features, values, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def ablation(
    train: DataFrame, test: DataFrame, model: str, seed: int, params: dict[str, Any],
    configurations: list[str] | None = None, row_id: str = "row_id",
) -> DataFrame:
    """Metrics of one model per feature configuration."""

    def scored(name: str) -> DataFrame:
        fitted = fit_one(model, params, train, ablation_features(name), seed, row_id)
        out = fitted.score(test).select(F.lit(name).alias("configuration"), "label", "prediction", "score")
        return stage(out, "ablation")

    tasks = [lambda n=name: scored(n) for name in configurations or list(ABLATIONS)]
    parts = at_once(train.sparkSession, tasks, fits_at_once(train))
    return evaluate(reduce(DataFrame.unionByName, parts), ["configuration"])


def both_directions(
    a: DataFrame, b: DataFrame, names: tuple[str, str], models: dict[str, dict[str, Any]], seed: int, row_id: str = "row_id"
) -> DataFrame:
    """20 against 11 columns, trained on one corpus and tested on the other, both ways."""

    def scored(train: DataFrame, test: DataFrame, direction: str, columns: list[str], model: str) -> DataFrame:
        out = fit_one(model, models[model], train, columns, seed, row_id).score(test)
        tagged = out.select(
            F.lit(direction).alias("direction"), F.lit(len(columns)).alias("columns"),
            F.lit(model).alias("model"), "label", "prediction", "score",
        )
        return stage(tagged, "directions")

    ways = [(a, b, f"{names[0]}->{names[1]}"), (b, a, f"{names[1]}->{names[0]}")]
    plan = [(*way, columns, model) for way in ways for columns in (FEATURES_20, flow_only_features()) for model in models]
    tasks = [lambda p=one: scored(*p) for one in plan]
    parts = at_once(a.sparkSession, tasks, fits_at_once(a))
    return evaluate(reduce(DataFrame.unionByName, parts), ["direction", "columns", "model"])


def duplicate_sensitivity(
    trained: Trained, test: DataFrame, caps: list[int | None], row_id: str = "row_id"
) -> DataFrame:
    """Metrics of one fitted model on test sets with capped duplicates."""
    scored = stage(trained.score(test), "scored")
    parts = [
        cap_duplicates(scored, trained.features, row_id, cap).select(
            F.lit(str(cap)).alias("cap"), "label", "prediction", "score"
        )
        for cap in caps
    ]
    return evaluate(stage(reduce(DataFrame.unionByName, parts), "capped"), ["cap"])


def save(trained: Trained, spark: SparkSession, path: str) -> None:
    """Spark ML model and scaler constants under ``path``."""
    PipelineModel(stages=[trained.model]).write().overwrite().save(f"{path}/model")
    if trained.scaler is not None:
        trained.scaler.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def load(spark: SparkSession, path: str, like: Trained) -> Trained:
    model = PipelineModel.load(f"{path}/model").stages[0]
    scaler = None
    if like.scaler is not None:
        rows = spark.read.parquet(f"{path}/scaler").collect()
        scaler = Scaler({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["std"] for r in rows})
    return Trained(like.name, like.params, like.features, scaler, model, like.validation_f1, like.from_margin)


def run_metadata(metrics: DataFrame) -> DataFrame:
    """Adds what a run needs to be repeated."""
    spark = metrics.sparkSession
    return metrics.withColumns(
        {
            "spark_version": F.lit(spark.version),
            "master": F.lit(spark.sparkContext.master),
            "parallelism": F.lit(spark.sparkContext.defaultParallelism),
            "evaluated_at": F.current_timestamp(),
        }
    )
