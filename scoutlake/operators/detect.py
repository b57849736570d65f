"""Detection scoring: rules, fusion with model scores, drift adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.functions.exprs import clamp


def rule_verdict() -> Column:
    """struct(prediction, confidence) of the fallback rules."""
    scan = (F.col("host_port_entropy") > 2.2) & (F.col("host_failed_flow_ratio") > 0.8)
    sweep = (F.col("host_dst_diversity") > 4) & (F.col("host_syn_ratio") > 0.8)
    confidence = F.when(scan, F.lit(0.95)).when(sweep, F.lit(0.90)).otherwise(F.lit(0.0))
    return F.struct((scan | sweep).cast("int").alias("prediction"), confidence.alias("confidence"))


def score_by_rules(features: DataFrame) -> DataFrame:
    verdict = rule_verdict()
    return features.withColumns(
        {"prediction": verdict["prediction"], "confidence": verdict["confidence"]}
    )


def isolation_confidence(anomaly: Column) -> Column:
    """Confidence of an isolation score that is positive for anomalies."""
    return clamp(anomaly + F.lit(0.5), 0.0, 1.0)


def fused(model_confidence: Column) -> dict[str, Column]:
    """70 % model, 30 % rules; positive from one half."""
    # Rounded so that a sum such as 0.7 * 0.5 + 0.3 * 0.5 lands on the threshold.
    mix = F.round(F.lit(0.7) * model_confidence + F.lit(0.3) * rule_verdict()["confidence"], 12)
    return {"prediction": (mix >= 0.5).cast("int"), "confidence": mix}


def score_flows(features: DataFrame, scored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Model verdicts (``prediction``, ``confidence`` by ``keys``) where there are any,
    else the rules; without a model the plan holds the rules only."""
    if scored is None:
        return score_by_rules(features)
    rules = rule_verdict()
    model = scored.select(
        *keys, F.col("prediction").alias("_p"), F.col("confidence").alias("_c")
    )
    return (
        features.join(model, keys, "left")
        .withColumns(
            {
                "prediction": F.coalesce("_p", rules["prediction"]),
                "confidence": F.coalesce("_c", rules["confidence"]),
            }
        )
        .drop("_p", "_c")
    )


def drift_adjusted(prediction: Column, confidence: Column, drift: Column) -> Column:
    """Predicted attacks lose 0.15 when the host behaves as usual, gain it when not."""
    calm = clamp(confidence - 0.15, 0.0, 1.0)
    upset = clamp(confidence + 0.15, 0.0, 1.0)
    return (
        F.when((prediction == 1) & (drift < 30), calm)
        .when((prediction == 1) & (drift > 60), upset)
        .otherwise(confidence)
    )
