"""Queries: classification metrics, curves, statistics over seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.registry import query, rounded, table
from scoutlake.catalog.sql import CTES, r6
from scoutlake.operators import metrics as me
from scoutlake.operators import stats as st
from scoutlake.schemas import METRIC_NAMES

MODELS = ["isolation_forest", "mlp", "random_forest", "svm", "xgboost"]
SEEDS = [42, 7, 13, 99, 2024]
RUN = st.RUN
RUN_SQL = "strategy, model, seed"

CTES["preds"] = """
SELECT s.strategy, m.model, sd.seed, l.doc_id AS row_id, l.quality AS label, d.lang AS attack_type, d.source AS vec,
  CAST((l.doc_id * 7919 + sd.seed * 31 + m.mno * 1009 + s.sno * 77 + d.n_chars) % 1000 * 7 + l.quality * (500 + 500 * m.mno) AS DOUBLE) / CAST(10000 AS DOUBLE) AS score,
  CAST(score >= 0.5 AS INT) AS prediction
FROM labels l JOIN documents d ON d.doc_id = l.doc_id,
  (VALUES ('cross_dataset', 0), ('time_wise', 1)) s(strategy, sno),
  (VALUES ('isolation_forest', 0), ('mlp', 1), ('random_forest', 2), ('svm', 3), ('xgboost', 4)) m(model, mno),
  (VALUES (42), (7), (13), (99), (2024)) sd(seed)"""
CTES["cells"] = f"""
SELECT {RUN_SQL}, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM preds GROUP BY {RUN_SQL}"""
RATES = """coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
  coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0) AS mcc"""
CTES["rated"] = f"SELECT *, {RATES} FROM cells"
CTES["tied"] = f"""
SELECT {RUN_SQL}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY {RUN_SQL}, score"""
CTES["running"] = f"""
SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {RUN_SQL}) AS p_all, sum(neg) OVER (PARTITION BY {RUN_SQL}) AS n_all
FROM tied WINDOW w AS (PARTITION BY {RUN_SQL} ORDER BY score DESC)"""
CTES["auc"] = f"""
SELECT {RUN_SQL}, sum(pos * (n_all - fp + neg / 2)) / max(p_all * n_all) AS roc_auc, sum(pos * tp / (tp + fp)) / max(p_all) AS pr_auc
FROM running GROUP BY {RUN_SQL}"""
CTES["allmet"] = f"SELECT * FROM rated JOIN auc USING ({RUN_SQL})"
CTES["longmet"] = f"""UNPIVOT (SELECT {RUN_SQL}, {", ".join(METRIC_NAMES)} FROM allmet) ON {", ".join(METRIC_NAMES)} INTO NAME metric VALUE value"""


def predictions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    # The 50 runs of the grid as a bounded explode per row.
    runs = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"), F.lit(i).alias("sno"), F.lit(m).alias("model"),
                F.lit(j).alias("mno"), F.lit(seed).alias("seed"),
            )
            for i, s in enumerate(["cross_dataset", "time_wise"])
            for j, m in enumerate(MODELS)
            for seed in SEEDS
        ]
    )
    grid = rows.select("*", F.explode(runs).alias("r")).select("*", "r.*").drop("r")
    noise = F.expr("(doc_id * 7919 + seed * 31 + mno * 1009 + sno * 77 + n_chars) % 1000 * 7")
    score = (noise + F.col("quality") * (500 + 500 * F.col("mno"))).cast("double") / F.lit(10000.0)
    return grid.select(
        *RUN,
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("label"),
        F.col("lang").alias("attack_type"),
        F.col("source").alias("vec"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("prediction"),
    )


def long_metrics(spark, sf):
    return st.to_long(me.evaluate(predictions(spark, sf), RUN), METRIC_NAMES)


@query("e1_confusion", f"SELECT {RUN_SQL}, tp, fp, tn, fn FROM cells")
def e1(spark, sf):
    return me.confusion(predictions(spark, sf), RUN)


@query("e2_e3_rates_mcc", f"SELECT {RUN_SQL}, {r6('accuracy', 'precision', 'recall', 'f1', 'mcc')} FROM rated")
def e2(spark, sf):
    cells = me.confusion(predictions(spark, sf), RUN)
    return rounded(me.rates(cells).drop("tp", "fp", "tn", "fn"))


@query("e4_e5_roc_pr_auc", f"SELECT {RUN_SQL}, {r6('roc_auc', 'pr_auc')} FROM auc")
def e4(spark, sf):
    return rounded(me.ranking(me.running_counts(predictions(spark, sf), RUN), RUN))


@query(
    "e6_roc_curve",
    f"""SELECT {RUN_SQL}, {r6("threshold=score", "fpr=fp / n_all", "tpr=tp / p_all")} FROM running
     UNION ALL SELECT DISTINCT {RUN_SQL}, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM preds""",
)
def e6(spark, sf):
    points = me.roc_points(me.running_counts(predictions(spark, sf), RUN), RUN)
    return points.select(*RUN, F.when(F.col("threshold") == float("inf"), F.col("threshold"))
                         .otherwise(F.round("threshold", 6)).alias("threshold"),
                         F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "e6_roc_trapezoid",
    f"""WITH pts AS (SELECT {RUN_SQL}, fp / n_all AS x, tp / p_all AS y, score FROM running UNION ALL SELECT DISTINCT {RUN_SQL}, 0.0, 0.0, 1e9 FROM preds),
       seg AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM pts WINDOW w AS (PARTITION BY {RUN_SQL} ORDER BY score DESC))
       SELECT {RUN_SQL}, {r6("auc=sum((x - x0) * (y + y0) / 2)")} FROM seg GROUP BY {RUN_SQL}""",
)
def e6_area(spark, sf):
    return rounded(me.roc_trapezoid(me.running_counts(predictions(spark, sf), RUN), RUN))


@query(
    "e7_pr_curve",
    f"SELECT {RUN_SQL}, {r6('threshold=score', 'recall=tp / p_all', 'precision=tp / (tp + fp)')} FROM running",
)
def e7(spark, sf):
    return rounded(me.pr_points(me.running_counts(predictions(spark, sf), RUN), RUN))


@query(
    "e7_pr_trapezoid",
    f"""WITH pts AS (SELECT {RUN_SQL}, tp / p_all AS x, tp / (tp + fp) AS y, score FROM running UNION ALL SELECT DISTINCT {RUN_SQL}, 0.0, 1.0, 1e9 FROM preds),
       seg AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM pts WINDOW w AS (PARTITION BY {RUN_SQL} ORDER BY score DESC))
       SELECT {RUN_SQL}, {r6("auc=sum((x - x0) * (y + y0) / 2)")} FROM seg GROUP BY {RUN_SQL}""",
)
def e7_area(spark, sf):
    return rounded(me.pr_trapezoid(me.running_counts(predictions(spark, sf), RUN), RUN))


@query("e8_score_source", f"SELECT {RUN_SQL}, row_id, {r6('score=1 / (1 + exp(0.5 - score))')} FROM preds")
def e8(spark, sf):
    rows = predictions(spark, sf).withColumn("decision", 0.5 - F.col("score"))
    return rounded(rows.select(*RUN, "row_id", me.score_column(decision="decision").alias("score")))


@query(
    "e9_auc_reconciliation",
    f"""SELECT {RUN_SQL}, {r6("computed=roc_auc", "stored=roc_auc + CASE WHEN seed = 7 THEN 0.01 ELSE 0.00001 END",
       "difference=CASE WHEN seed = 7 THEN 0.01 ELSE 0.00001 END")}, seed <> 7 AS agrees FROM auc""",
)
def e9(spark, sf):
    computed = me.ranking(me.running_counts(predictions(spark, sf), RUN), RUN)
    shift = F.when(F.col("seed") == 7, 0.01).otherwise(0.00001)
    return rounded(me.reconcile(computed, computed.withColumn("roc_auc", F.col("roc_auc") + shift), RUN))


@query(
    "e10_seed_summary",
    """SELECT strategy, model, metric, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS std, count(*) AS n_seeds
       FROM longmet GROUP BY ALL""",
)
def e10(spark, sf):
    return st.seed_summary(long_metrics(spark, sf))


FRIEDMAN_SQL = f"""WITH rnk AS (SELECT *, rank() OVER (PARTITION BY strategy, metric, seed ORDER BY value)
    + (count(*) OVER (PARTITION BY strategy, metric, seed, value) - 1) / 2 AS r FROM longmet),
pm AS (SELECT strategy, metric, model, sum(r) AS s FROM rnk GROUP BY ALL),
tie AS (SELECT strategy, metric, sum(t * t * t - t) AS ties FROM (SELECT strategy, metric, seed, value, count(*) AS t FROM rnk GROUP BY ALL) GROUP BY ALL),
st AS (SELECT strategy, metric, (12.0 / (5 * 5 * 6) * sum(s * s) - 3 * 5 * 6) / (1 - max(ties) / (5 * 5 * 24)) AS x FROM pm JOIN tie USING (strategy, metric) GROUP BY ALL)
SELECT strategy, metric, 5 AS models, 5 AS seeds, {r6("statistic=x", "p_value=exp(-x / 2) * (1 + x / 2)")},
  exp(-x / 2) * (1 + x / 2) < 0.05 AS significant_005 FROM st"""


@query("e11_friedman", FRIEDMAN_SQL)
def e11(spark, sf):
    return rounded(st.friedman(long_metrics(spark, sf)))


WILCOXON_SQL = f"""WITH d AS (SELECT a.strategy, a.metric, a.model AS model_a, b.model AS model_b, round(a.value - b.value, 12) AS d
   FROM longmet a JOIN longmet b ON a.strategy = b.strategy AND a.metric = b.metric AND a.seed = b.seed AND a.model < b.model),
rk AS (SELECT *, rank() OVER (PARTITION BY strategy, metric, model_a, model_b ORDER BY abs(d))
    + (count(*) OVER (PARTITION BY strategy, metric, model_a, model_b, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
w AS (SELECT strategy, metric, model_a, model_b, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic FROM rk GROUP BY ALL)
SELECT strategy, metric, model_a, model_b, 5 AS seeds, {r6("statistic=coalesce(statistic, 0)", "attainable_p=least(1.0, 10 * 0.0625)")}
FROM (SELECT DISTINCT strategy, metric, model_a, model_b FROM d) LEFT JOIN w USING (strategy, metric, model_a, model_b)"""


@query("e12_wilcoxon_statistic", WILCOXON_SQL)
def e12(spark, sf):
    out = st.wilcoxon(long_metrics(spark, sf))
    return rounded(out, "strategy", "metric", "model_a", "model_b", "seeds", "statistic", "attainable_p")


@query("e12_wilcoxon_p_values")
def e12_p(spark, sf):
    return rounded(st.wilcoxon(long_metrics(spark, sf)))


MC_BASE = """WITH bc AS (SELECT a.strategy, a.seed, a.model AS model_a, b.model AS model_b, count(*) AS n,
   count(*) FILTER (a.prediction = a.label AND b.prediction <> b.label) AS b, count(*) FILTER (a.prediction <> a.label AND b.prediction = b.label) AS c
   FROM preds a JOIN preds b ON a.strategy = b.strategy AND a.seed = b.seed AND a.row_id = b.row_id AND a.model < b.model GROUP BY ALL)"""


@query(
    "e13_mcnemar",
    f"{MC_BASE} SELECT strategy, seed, model_a, model_b, n, b, c, {r6('chi2=coalesce((abs(b - c) - 1) * (abs(b - c) - 1) / nullif(b + c, 0), 0)')} FROM bc",
)
def e13(spark, sf):
    return rounded(st.mcnemar(predictions(spark, sf), ["strategy", "seed"]).drop("p_value"))


@query(
    "e14_pooled_mcnemar",
    f"""{MC_BASE}, pool AS (SELECT strategy, model_a, model_b, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c FROM bc GROUP BY ALL)
    SELECT strategy, model_a, model_b, n, b, c, {r6("chi2=coalesce((abs(b - c) - 1) * (abs(b - c) - 1) / nullif(b + c, 0), 0)")} FROM pool""",
)
def e14(spark, sf):
    return rounded(
        st.pooled_mcnemar(predictions(spark, sf)).drop("p_value", "p_corrected", "significant")
    )


@query("e14_pooled_mcnemar_p_values")
def e14_p(spark, sf):
    return rounded(st.pooled_mcnemar(predictions(spark, sf)))


@query(
    "e15_subtype_metrics",
    f"""WITH cells2 AS (SELECT {RUN_SQL}, attack_type, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM preds GROUP BY ALL),
      r AS (SELECT *, {RATES} FROM cells2)
      SELECT {RUN_SQL}, attack_type, tp, fp, tn, fn, {r6("accuracy", "precision", "recall", "f1", "mcc")} FROM r""",
)
def e15(spark, sf):
    return rounded(me.per_subtype(predictions(spark, sf), RUN))


@query("e16_bootstrap_interval")
def e16(spark, sf):
    return rounded(st.bootstrap_interval(predictions(spark, sf), RUN))


@query(
    "e17_best_model",
    """WITH m AS (SELECT strategy, model, round(avg(value), 12) AS mean FROM longmet WHERE metric = 'f1' GROUP BY ALL),
      b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY mean DESC, model) = 1)
      SELECT b.strategy, b.model, round(b.mean, 6) AS mean, arg_min(l.seed, (round(abs(l.value - b.mean), 12), l.seed)) AS seed
      FROM b JOIN longmet l ON l.strategy = b.strategy AND l.model = b.model AND l.metric = 'f1' GROUP BY b.strategy, b.model, b.mean""",
)
def e17(spark, sf):
    return rounded(st.best_models(long_metrics(spark, sf)))


@query(
    "e18_metric_matrix",
    "SELECT strategy, " + r6(*[f"{m}=avg(value) FILTER (model = '{m}')" for m in MODELS])
    + " FROM longmet WHERE metric = 'f1' GROUP BY strategy",
)
def e18(spark, sf):
    return rounded(st.metric_matrix(long_metrics(spark, sf), "f1", MODELS))


@query(
    "e19_summed_confusion",
    """SELECT strategy, model, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp
       FROM cells GROUP BY ALL""",
)
def e19(spark, sf):
    return st.summed_confusion(me.confusion(predictions(spark, sf), RUN))


@query(
    "e20_attribution_ranking",
    f"SELECT model AS feature, {r6('importance=avg(abs(score - 0.5))')} FROM preds GROUP BY model",
)
def e20(spark, sf):
    values = predictions(spark, sf).select(F.col("model").alias("feature"), (F.col("score") - 0.5).alias("value"))
    return rounded(st.attribution_ranking(values))


@query(
    "e22_class_scores",
    f"""SELECT {RUN_SQL}, label, {r6("mean_score=avg(score)")}, count(*) AS rows, count(DISTINCT (vec, attack_type)) AS distinct_vectors
        FROM preds GROUP BY {RUN_SQL}, label""",
)
def e22(spark, sf):
    return rounded(me.class_scores(predictions(spark, sf), RUN, ["vec", "attack_type"]))


@query(
    "e23_importance_share",
    f"SELECT seed, {r6('importance=sum(score)')} FROM preds WHERE model LIKE 'x%' GROUP BY seed",
)
def e23(spark, sf):
    rows = predictions(spark, sf).select("seed", F.col("model").alias("feature"), F.col("score").alias("importance"))
    return rounded(st.importance_share(rows, "x"))


def _side(name, tp, fp, fn):
    return f"""SELECT {RUN_SQL}, '{name}' AS class, coalesce({tp} / nullif({tp} + {fp}, 0), 0.0) AS precision,
      coalesce({tp} / nullif({tp} + {fn}, 0), 0.0) AS recall, coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0) AS f1, {tp} + {fn} AS support FROM cells"""


@query(
    "e25_class_report",
    f"""WITH c AS ({_side("0", "tn", "fn", "fp")} UNION ALL {_side("1", "tp", "fp", "fn")}),
    allc AS (SELECT * FROM c
     UNION ALL SELECT {RUN_SQL}, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM c GROUP BY {RUN_SQL}
     UNION ALL SELECT {RUN_SQL}, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1 * support) / sum(support), sum(support) FROM c GROUP BY {RUN_SQL})
    SELECT {RUN_SQL}, class, {r6("precision", "recall", "f1")}, CAST(support AS BIGINT) AS support FROM allc""",
)
def e25(spark, sf):
    return rounded(me.class_report(predictions(spark, sf), RUN))


@query("e2_consistent_test_sets", "SELECT strategy, count(DISTINCT n) AS test_sets, count(DISTINCT n) = 1 AS comparable FROM (SELECT strategy, tp + fp + tn + fn AS n FROM cells) GROUP BY strategy")
def e2_consistent(spark, sf):
    runs = me.evaluate(predictions(spark, sf), RUN).withColumn("test_set_id", F.col("strategy"))
    return st.same_test_set(runs)
