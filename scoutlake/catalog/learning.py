"""Queries: scaling, models, ablation, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.flows import RULES_SQL
from scoutlake.catalog.prep import DATASET, TON_RAW, derived
from scoutlake.catalog.registry import query, rounded
from scoutlake.catalog.sql import RULE_CONFIDENCE, r6
from scoutlake.operators import attribution as at
from scoutlake.operators import metrics as me
from scoutlake.operators import models as mo
from scoutlake.operators import splits as sp
from scoutlake.operators import stats as st
from scoutlake.operators.prep import map_ton_iot
from scoutlake.plans.features import labelled_features
from scoutlake.schemas import FEATURES_20
from scoutlake.session import new_folder, stage
from scoutlake.sources.events_view import read_packets

# One setting of each declared grid, for the queries about one fitted model.
DECLARED = {
    "random_forest": {"trees": 100, "depth": 15},
    "xgboost": {"depth": 5, "rate": 0.1, "rounds": 100},
    "svm": {"C": 1.0, "iterations": 100},
    "isolation_forest": {"contamination": 0.1, "trees": 100},
    "mlp": {"hidden": 100, "iterations": 200},
}


def dataset(spark, sf):
    """All labelled flows of the capture, random train/val/test by label."""
    rows = labelled_features(read_packets(spark, sf)).withColumnRenamed("first_id", "row_id")
    rows = stage(rows.select("row_id", "label", *FEATURES_20), "labelled")
    test = sp.stratified_split(rows, "label", "row_id", 0.2)
    pool = test.filter("NOT held_out").drop("held_out")
    val = sp.stratified_split(pool, "label", "row_id", 0.15, seed=7)
    subset = F.when(F.col("held_out"), "val").otherwise("train")
    parts = val.withColumn("subset", subset).drop("held_out").unionByName(
        test.filter("held_out").drop("held_out").withColumn("subset", F.lit("test"))
    )
    return stage(parts.withColumn("strategy", F.lit("random")).hint("rebalance"), "split")


def part(split, name):
    return split.filter(F.col("subset") == name)


def judged(trained, rows, key, value):
    """Scores of ``rows``, written once: the metrics read them three times."""
    return stage(trained.score(rows).select(F.lit(value).alias(key), "label", "prediction", "score"), "scored")


@query(
    "m1_standard_scaler",
    f"""SELECT row_id, {r6("f1=(f1 - (SELECT avg(f1) FROM dset)) / (SELECT stddev_pop(f1) FROM dset)", "f2=(f2 - (SELECT avg(f2) FROM dset)) / (SELECT stddev_pop(f2) FROM dset)", "one=0.0")} FROM dset""",
)
def m1(spark, sf):
    rows = derived(spark, sf, DATASET).withColumn("one", F.lit(1.0))
    scaler = mo.fit_scaler(rows, ["f1", "f2", "one"])
    return rounded(scaler.transform(rows), "row_id", "f1", "f2", "one")


def _model_query(name):
    def run(spark, sf):
        split = dataset(spark, sf)
        best = mo.tune(name, part(split, "train"), part(split, "val"), 42)
        return rounded(me.evaluate(judged(best, part(split, "test"), "model", name), ["model"]))

    return run


for _id, _name in [("m2", "random_forest"), ("m3", "xgboost"), ("m4", "svm"), ("m5", "isolation_forest"), ("m6", "mlp")]:
    query(f"{_id}_{_name}")(_model_query(_name))


@query("m7_grid_search")
def m7(spark, sf):
    split = dataset(spark, sf)
    best = mo.tune("random_forest", part(split, "train"), part(split, "val"), 42)
    return rounded(me.evaluate(judged(best, part(split, "test"), "setting", str(best.params)), ["setting"]))


@query("m8_threshold", f"SELECT flow_id, CAST(flow_syn_ratio >= 0.5 AS INT) AS prediction FROM f20")
def m8(spark, sf):
    from scoutlake.plans.features import features

    return features(read_packets(spark, sf)).select("flow_id", mo.threshold(F.col("flow_syn_ratio")).alias("prediction"))


SEEDS = [42, 7, 13]


def strategies(spark, sf):
    """The capture's flows split at random, by time and by host, and all of them against a
    second corpus."""
    rows = labelled_features(read_packets(spark, sf)).withColumnRenamed("first_id", "row_id")
    rows = stage(rows.select("row_id", "label", "src_ip", "start_s", *FEATURES_20), "labelled")
    names = ["row_id", "label", *FEATURES_20, "subset", "strategy"]
    in_time = sp.temporal_split(rows, "start_s", "row_id").withColumn("strategy", F.lit("temporal"))
    # A fifth of the hosts that attack and of those that do not.
    hosts = rows.groupBy("src_ip").agg(F.max("label").alias("attacks"))
    apart = sp.host_split(rows, sp.stratified_split(hosts, "attacks", "src_ip", 0.2).filter("held_out"))
    by_host = sp.three_way(
        apart.filter("subset = 'train'").drop("subset"), apart.filter("subset = 'test'").drop("subset"),
        "label", "row_id", "host", 0.15,
    )
    other = map_ton_iot(derived(spark, sf, TON_RAW)).withColumn("row_id", F.monotonically_increasing_id())
    pool = rows.select("row_id", "label", *FEATURES_20)
    across = sp.three_way(pool, other.select(pool.columns), "label", "row_id", "cross_dataset", 0.15)
    out = dataset(spark, sf).select(names)
    for more in (in_time, by_host, across):
        out = out.unionByName(more.select(names))
    return out


@query("m9_training_grid")
def m9(spark, sf):
    grids = {k: [v] for k, v in DECLARED.items()}
    splits, folder = strategies(spark, sf), new_folder(spark, "grid")
    mo.train_grid(splits, list(mo.FAMILIES), SEEDS[:1], folder, grids=grids)
    # The same folder again: only the runs with the other seeds are new.
    some = splits.filter("strategy = 'random'")
    predictions, _ = mo.train_grid(some, ["random_forest", "svm"], SEEDS, folder, grids=grids)
    return rounded(me.evaluate(predictions, st.RUN))


@query("m10_feature_importances")
def m10(spark, sf):
    split = dataset(spark, sf)
    forest = mo.fit_one("random_forest", DECLARED["random_forest"], part(split, "train"), FEATURES_20, 42)
    return rounded(mo.importances(spark, forest))


@query("m11_ablation")
def m11(spark, sf):
    split = dataset(spark, sf)
    out = mo.ablation(part(split, "train"), part(split, "test"), "random_forest", 42, DECLARED["random_forest"])
    return rounded(out)


@query("m11_both_directions")
def m11_directions(spark, sf):
    split = dataset(spark, sf)
    models = {k: DECLARED[k] for k in ("random_forest", "svm")}
    even, odd = split.filter("row_id % 2 = 0"), split.filter("row_id % 2 = 1")
    return rounded(mo.both_directions(even, odd, ("A", "B"), models, 42))


@query("m12_third_dataset")
def m12(spark, sf):
    split = dataset(spark, sf)
    forest = mo.fit_one("random_forest", DECLARED["random_forest"], part(split, "train"), FEATURES_20, 42)
    third = map_ton_iot(derived(spark, sf, TON_RAW))
    return rounded(me.evaluate(judged(forest, third, "model", "random_forest"), ["model"]))


@query("m13_duplicate_sensitivity")
def m13(spark, sf):
    split = dataset(spark, sf)
    forest = mo.fit_one("random_forest", DECLARED["random_forest"], part(split, "train"), FEATURES_20, 42)
    return rounded(mo.duplicate_sensitivity(forest, part(split, "test"), [1, 2, 5, 10, None]))


@query(
    "m14_rule_model",
    f"""WITH p AS (SELECT CAST({RULES_SQL} AS INT) AS label, CAST({RULE_CONFIDENCE} > 0 AS INT) AS prediction FROM f20)
       SELECT 'rule_based' AS model, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM p""",
)
def m14(spark, sf):
    scored = mo.rule_predictions(labelled_features(read_packets(spark, sf))).withColumn("model", F.lit("rule_based"))
    return me.confusion(scored, ["model"])


@query("m15_save_and_load")
def m15(spark, sf):
    split = dataset(spark, sf)
    fitted = mo.fit_one("svm", DECLARED["svm"], part(split, "train"), FEATURES_20, 42)
    path = new_folder(spark, "model")
    mo.save(fitted, spark, path)
    again = mo.load(spark, path, fitted)
    test = part(split, "test").select("row_id", "label", *FEATURES_20)
    before = fitted.score(test).select("row_id", F.col("score").alias("before"))
    both = again.score(test).select("row_id", F.col("score").alias("after")).join(before, "row_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") == F.col("after")).alias("equal"))


@query(
    "c2_model_scoring",
)
def c2(spark, sf):
    split = dataset(spark, sf)
    forest = mo.fit_one("random_forest", DECLARED["random_forest"], part(split, "train"), FEATURES_20, 42)
    return rounded(forest.score(split).select("row_id", "label", "prediction", "score"))


@query("e21_attributions")
def e21(spark, sf):
    split = dataset(spark, sf)
    forest = mo.fit_one("random_forest", DECLARED["random_forest"], part(split, "train"), FEATURES_20, 42)
    test = part(split, "test").select("row_id", *FEATURES_20)
    sample = sp.random_rows(test, 100, "row_id")
    values = at.shapley(sample, test, FEATURES_20, "row_id", forest.score)
    return rounded(st.attribution_ranking(values))


@query("e24_run_metadata")
def e24(spark, sf):
    split = dataset(spark, sf)
    scored = mo.rule_predictions(part(split, "test")).withColumn("model", F.lit("rule_based"))
    runs = me.evaluate(scored.select("model", "label", "prediction", "score"), ["model"])
    return rounded(mo.run_metadata(runs).drop("evaluated_at"))
