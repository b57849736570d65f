"""Metrics, statistics, splits, forests: published or brute-force values."""

from __future__ import annotations

import bisect
import random
import threading

import pytest
from pyspark.sql import functions as F

from scoutlake.session import new_folder
from scoutlake.schemas import FEATURES_20
from scoutlake.functions.pvalues import chi2_tail, signed_rank_tail
from scoutlake.operators import attribution as at
from scoutlake.operators import iforest
from scoutlake.operators import metrics as me
from scoutlake.operators import models as mo
from scoutlake.operators import splits as sp
from scoutlake.operators import stats as st


def test_rates_from_published_matrix(spark):
    cells = spark.createDataFrame([(507, 6372, 3628, 158423)], "tp long, fp long, tn long, fn long")
    got = me.rates(cells).first()
    want = {"accuracy": 0.0244776, "precision": 0.0737026, "recall": 0.0031901, "f1": 0.0061155, "mcc": -0.7570254}
    assert {k: round(got[k], 7) for k in want} == want


def predictions(spark, n=300, seed=5, digits=1):
    rng = random.Random(seed)
    rows = [("r", rng.randint(0, 1), round(rng.random(), digits)) for _ in range(n)]
    return rows, spark.createDataFrame([(k, y, s, int(s >= 0.5)) for k, y, s in rows], "k string, label int, score double, prediction int")


def brute_auc(rows):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_with_ties(spark, digits):
    rows, df = predictions(spark, digits=digits)
    counts = me.running_counts(df, ["k"])
    got = me.ranking(counts, ["k"]).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(rows))
    assert me.roc_trapezoid(counts, ["k"]).first()["auc"] == pytest.approx(got)
    flipped = df.withColumn("score", 1 - F.col("score"))
    other = me.ranking(me.running_counts(flipped, ["k"]), ["k"]).first()["roc_auc"]
    assert got + other == pytest.approx(1.0)


def test_ranks_of_crowded_scores_are_cut_into_even_ranges(spark):
    """Nine tenths of the scores stand within 1e-6 of 1; ranks stay exact, null ranks lowest."""
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 1), 1 - rng.random() * 1e-6 if k % 10 else rng.random()) for k in range(3000)]
    rows += [("cold", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(200)] + [("none", 1, None), ("none", 0, 0.5)]
    df = spark.createDataFrame(rows, "k string, label int, score double")
    tied = df.groupBy("k", "score").count()
    cuts = {r.k: r.cuts for r in me.score_cuts(tied, ["k"], 50).collect()}
    assert len(cuts["cold"]) <= 2 and cuts["none"] == [] and cuts["hot"] == sorted(set(cuts["hot"]))
    scores = sorted(s for k, _, s in rows if k == "hot")
    edges = [0, *(bisect.bisect_right(scores, c) for c in cuts["hot"]), len(scores)]
    assert max(b - a for a, b in zip(edges, edges[1:])) <= 100
    got = {(r.k, r.score): r for r in me.running_counts(df, ["k"], 50).collect()}
    for run in ("hot", "cold"):
        mine = [(y, s) for k, y, s in rows if k == run]
        for s in {s for _, s in mine}:
            r = got[run, s]
            assert (r.pos, r.neg) == tuple(sum(x == s and y == want for y, x in mine) for want in (1, 0))
            assert (r.pos_above, r.neg_above) == tuple(sum(x > s and y == want for y, x in mine) for want in (1, 0))
            assert r.pos_all + r.neg_all == len(mine)
    assert got["none", None].neg_above == 1 and got["none", 0.5].pos_above == 0
    assert me.running_counts(df.limit(0), ["k"]).count() == 0


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("r", 1, 0.3, 0)], "k string, label int, score double, prediction int")
    got = me.evaluate(df, ["k"]).first()
    assert got["roc_auc"] is None and got["pr_auc"] is None and got["f1"] == 0.0


def test_p_values():
    assert round(chi2_tail(20.0, 4), 6) == 0.000499 and round(chi2_tail(19.36, 4), 6) == 0.000668
    assert round(chi2_tail(7.1111, 1), 5) == 0.00766
    assert chi2_tail(3.0, 3) == pytest.approx(0.3916252, abs=1e-6)
    assert signed_rank_tail([1, 2, 3, 4, 5], 0) == pytest.approx(0.0625)
    assert signed_rank_tail([1, 2, 3, 4, 5], 3) == pytest.approx(0.3125)


def test_mcnemar(spark):
    rows = [(i, "a", 1, 1) for i in range(9)] + [(i, "b", 1, 0) for i in range(9)]
    rows += [(100, "a", 0, 0), (100, "b", 0, 0)]
    df = spark.createDataFrame([("s", 1, *r) for r in rows], "strategy string, seed int, row_id int, model string, label int, prediction int")
    got = st.mcnemar(df, ["strategy", "seed"]).first()
    assert (got["n"], got["b"], got["c"]) == (10, 9, 0)
    assert round(got["chi2"], 4) == 7.1111 and round(got["p_value"], 5) == 0.00766


def long(spark, table):
    rows = [("s", m, i, "f1", v) for m, vs in table.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "strategy string, model string, seed int, metric string, value double")


def test_friedman_perfect_order(spark):
    table = {m: [k / 10 + (i + 1) * k / 100 for i in range(5)] for k, m in enumerate("abcde")}
    got = st.friedman(long(spark, table)).first()
    assert got["statistic"] == pytest.approx(20.0) and round(got["p_value"], 6) == 0.000499
    pairs = st.wilcoxon(long(spark, table)).collect()
    assert len(pairs) == 10 and {round(r["p_value"], 4) for r in pairs} == {0.0625}
    assert {r["attainable_p"] for r in pairs} == {0.625}


def test_bootstrap_stays_in_bounds(spark):
    _, df = predictions(spark)
    got = st.bootstrap_interval(df, ["k"], replicates=200).first()
    assert 0 <= got["f1_low"] < got["f1_high"] <= 1 and -1 <= got["mcc_low"] < got["mcc_high"] <= 1


@pytest.mark.parametrize("fraction", [0.0, 0.2, 1.0])
def test_stratified_split_is_exact_and_stable(spark, fraction):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 < 3).cast("int").alias("label"))
    cut = sp.stratified_split(df, "label", "row_id", fraction)
    sizes = {r["label"]: r["n"] for r in cut.groupBy("label").agg(F.count_if("held_out").alias("n")).collect()}
    assert sizes == {0: round(700 * fraction), 1: round(300 * fraction)}
    again = sp.stratified_split(df.repartition(7), "label", "row_id", fraction)
    assert cut.exceptAll(again).count() == 0


def test_temporal_split_with_one_crowded_instant(spark):
    """Most rows share one timestamp; the cut-off then falls between row ids."""
    df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") < 80, 5.0).otherwise(F.col("id") * 1.0).alias("t"))
    got = {r["subset"]: r["ids"] for r in sp.temporal_split(df, "t", "row_id").groupBy("subset").agg(F.sort_array(F.collect_list("row_id")).alias("ids")).collect()}
    assert got == {"train": list(range(70)), "val": list(range(70, 80)), "test": list(range(80, 100))}


@pytest.mark.parametrize("limit", [10**6, 7])
def test_cut_inside_a_crowded_bucket(spark, limit):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"), F.lit(5.0).alias("t"))
    cuts = sp.cut_points(df.repartition(6), "g", "row_id", F.col("t"), F.lit(60), F.lit(0), limit)
    assert {r["g"]: r["_cut"]["i"] for r in cuts.collect()} == {0: 118, 1: 119}


def test_verification_names_the_subset(spark):
    df = spark.createDataFrame([("s", "train", 0), ("s", "train", 1), ("s", "test", 1)], "strategy string, subset string, label int")
    with pytest.raises(ValueError, match="s/test"):
        sp.verify_split(df)


def test_duplicate_cap(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 3 else float(i)) for i in range(6)], "row_id int, f double")
    assert [sp.cap_duplicates(df, ["f"], "row_id", c).count() for c in (1, 2, None)] == [4, 5, 6]


def blobs(spark, n=400):
    rng = random.Random(1)
    rows = [(i, int(i % 10 == 0), *[rng.gauss(6.0 if i % 10 == 0 else 0.0, 1.0) for _ in range(3)]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double")


def test_isolation_forest_finds_outliers(spark):
    df = blobs(spark)
    forest = iforest.fit(df, ["a", "b", "c"], "row_id", trees=30, sample=64)
    scored = forest.predict(df).withColumn("k", F.lit("k"))
    assert me.evaluate(scored.select("k", "label", "prediction", "score"), ["k"]).first()["roc_auc"] > 0.95
    again = iforest.fit(df.repartition(5), ["a", "b", "c"], "row_id", trees=30, sample=64)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    )


def test_tuning_prefers_the_first_of_equals_and_scaler_handles_constants(spark):
    df = blobs(spark).withColumn("one", F.lit(3.0))
    best = mo.tune("svm", df, df, 1, ["a", "b", "c", "one"], [{"C": c, "iterations": 10} for c in (1.0, 5.0)])
    assert best.validation_f1 > 0.9 and best.params["C"] in (1.0, 5.0)
    assert best.scaler.std["one"] == 1.0
    kept = best.score(df)
    assert kept.select("a").exceptAll(df.select("a")).count() == 0


def test_attributions_add_up(spark):
    df = blobs(spark, 60)
    names = ["a", "b", "c"]

    def score(rows):
        return rows.withColumn("score", F.col("a") * 2 + F.col("b") * F.col("c"))

    got = at.shapley(df.limit(5), df, names, "row_id", score, permutations=4)
    base = df.orderBy(F.xxhash64("row_id", F.lit(42)), "row_id").limit(4)
    mean = score(base).agg(F.avg("score")).first()[0]
    total = got.groupBy("row_id").agg(F.sum("value").alias("v")).join(score(df), "row_id")
    for r in total.collect():
        assert r["v"] == pytest.approx(r["score"] - mean)


def test_training_grid_goes_on_where_it_stopped(spark):
    near = [(F.col("label") + F.rand(k)).alias(c) for k, c in enumerate(FEATURES_20)]
    rows = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    rows = rows.select("row_id", "label", *near, F.element_at(F.array(*map(F.lit, ["train", "val", "test"])), (F.col("row_id") % 3 + 1).cast("int")).alias("subset"))
    splits = rows.withColumn("strategy", F.lit("a")).unionByName(rows.withColumn("strategy", F.lit("b")))
    grids = {"random_forest": [{"trees": 3, "depth": d} for d in (2, 3)], "svm": [{"C": 1.0, "iterations": 5}]}
    folder = new_folder(spark, "grid")
    # What a lost run left behind: predictions without an entry in the table of runs.
    lost = spark.createDataFrame([(1, 0, 0, 0.5)], "row_id long, label int, prediction int, score double")
    for seed in (2, 9):
        lost.write.parquet(f"{folder}/predictions/strategy=a/model=svm/seed={seed}")
    first, runs = mo.train_grid(splits, ["random_forest", "svm"], [1], folder, grids=grids)
    keys = ["strategy", "model", "seed"]
    assert runs.count() == 4 and {r["count"] for r in first.groupBy(keys).count().collect()} == {200}

    def written():
        found = spark.read.parquet(f"{folder}/predictions").where("seed = 1")
        return {r[0] for r in found.select(F.input_file_name()).distinct().collect()}

    files = written()
    again, runs = mo.train_grid(splits, ["random_forest", "svm"], [1, 2], folder, grids=grids)
    counts = {tuple(r[k] for k in keys): r["count"] for r in again.groupBy(keys).count().collect()}
    assert counts == {(s, m, k): 200 for s in "ab" for m in ("random_forest", "svm") for k in (1, 2)}
    assert runs.groupBy(keys).count().where("count > 1").count() == 0 and runs.count() == 8
    assert written() == files  # the runs that were done are not trained again
    assert me.evaluate(again, keys).where("accuracy < 0.8").count() == 0


def test_fits_of_a_grid_run_at_once_and_the_first_of_equals_wins(spark, monkeypatch):
    """Each fit waits for the other; one after another they would wait in vain."""
    both = threading.Barrier(2, timeout=60)
    fit_one = mo.fit_one

    def together(*args):
        both.wait()
        return fit_one(*args)

    monkeypatch.setattr(mo, "fit_one", together)
    df = blobs(spark)
    grid = [{"trees": 5, "depth": d} for d in (4, 3)]
    assert mo.tune("random_forest", df, df, 1, ["a", "b", "c"], grid).params == grid[0]
    folder = new_folder(spark, "grid")
    splits = df.withColumn("subset", F.explode(F.array(*map(F.lit, ["train", "val", "test"])))).withColumn("strategy", F.lit("a"))
    _, runs = mo.train_grid(splits, ["random_forest"], [1, 2], folder, ["a", "b", "c"], {"random_forest": grid[:1]})
    assert [r.seed for r in runs.orderBy("seed").collect()] == [1, 2]


def test_boosted_trees_take_copies_as_weights(spark):
    """Repeated rows reach the boosted trees once; the scores are those of all rows."""
    names = ["a", "b", "c"]
    once = blobs(spark, 80).localCheckpoint()
    rows = once.withColumn("row_id", F.explode(F.sequence(F.lit(0), F.col("row_id") % 7)))
    counted = mo.counted_rows(rows, names)
    assert counted.count() == once.count() and counted.agg(F.sum("copies")).first()[0] == rows.count()
    params = {"depth": 2, "rate": 0.1, "rounds": 5}
    got = mo.fit_one("xgboost", params, rows, names, 1)
    want = mo.GBTClassifier(labelCol="label", maxDepth=2, stepSize=0.1, maxIter=5, seed=1).fit(mo.vectors(rows, names))
    probability = F.element_at(mo.vector_to_array("probability"), 2).alias("want")
    pairs = got.score(once).select(*names, "score").join(want.transform(mo.vectors(once, names)).select(*names, probability), names)
    for r in pairs.collect():
        assert r.score == pytest.approx(r.want, abs=1e-9)


def test_forests_keep_node_ids(spark):
    build = mo.FAMILIES["random_forest"].build
    assert build({"trees": 2, "depth": 2}, 1, 3, 10).getCacheNodeIds()
