"""Hybrid alert score, evidence, severity, alert records, cool-down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.functions.chains import spaced_chain
from scoutlake.functions.exprs import clamp, compact_array, fixed, protocol_name, total, utc_text
from scoutlake.params import DEFAULT


@dataclass(frozen=True)
class Step:
    """One measured quantity with two strict thresholds, their weights and words."""

    value: str
    high: float
    high_weight: float
    high_text: str
    low: float
    low_weight: float
    low_text: str
    style: str

    def weight(self) -> Column:
        v = F.col(self.value)
        return (
            F.when(v > self.high, F.lit(self.high_weight))
            .when(v > self.low, F.lit(self.low_weight))
            .otherwise(F.lit(0.0))
        )

    def evidence(self) -> Column:
        v = F.col(self.value)
        shown = {
            "bits": F.concat(fixed(v, 3)),
            "percent": F.concat(fixed(v * 100, 1), F.lit("%")),
            "hosts": F.concat(v.cast("int").cast("string"), F.lit(" hosts")),
            "score": F.concat(fixed(v, 1), F.lit("/100")),
        }[self.style]

        def said(text: str) -> Column:
            return F.concat(F.lit(text + " ("), shown, F.lit(")"))

        return F.when(v > self.high, said(self.high_text)).when(
            v > self.low, said(self.low_text)
        )


# Thresholds, weights and evidence words of the hybrid score.
STEPS = [
    Step("host_port_entropy", 3.0, 0.20, "Critical Destination Port Entropy",
         2.0, 0.10, "Moderate Destination Port Entropy", "bits"),
    Step("host_failed_flow_ratio", 0.8, 0.20, "Severe Failed Connection Rate",
         0.5, 0.10, "Elevated Failed Connection Rate", "percent"),
    Step("host_dst_diversity", 10, 0.15, "Critical Subnet Target Diversity",
         4, 0.08, "Moderate Subnet Target Diversity", "hosts"),
    Step("drift_score", 75.0, 0.20, "Severe Behavioral Drift Score",
         40.0, 0.10, "Moderate Behavioral Drift Score", "score"),
]
ALERT_CATEGORY = "Stealth Reconnaissance Scan"


def alert_score() -> Column:
    model = F.col("confidence") * F.when(F.col("prediction") == 1, 0.45).otherwise(0.1)
    raw = total([model, *[s.weight() for s in STEPS]])
    # Rounded so that weights adding up to a severity bound reach it.
    return clamp(F.round(raw, 9), 0.0, 1.0)


def alert_evidence() -> Column:
    model = F.when(
        F.col("prediction") == 1,
        F.concat(
            F.lit("ML Model Classification (Confidence: "),
            fixed(F.col("confidence") * 100, 1),
            F.lit("%)"),
        ),
    )
    return compact_array([model, *[s.evidence() for s in STEPS]])


def alert_severity(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")


def score_alerts(scored: DataFrame) -> DataFrame:
    """Adds alert_score, severity and evidence. Needs prediction, confidence and
    drift_score next to the features; drift_notes (array) is optional."""
    if "drift_notes" not in scored.columns:
        scored = scored.withColumn("drift_notes", F.array().cast("array<string>"))
    return scored.withColumn("alert_score", alert_score()).withColumns(
        {
            "severity": alert_severity(F.col("alert_score")),
            "evidence": F.concat(alert_evidence(), F.col("drift_notes")),
        }
    )


def alert_id() -> Column:
    """Same flow, same end, same id; the id does not depend on when it was computed."""
    key = F.concat_ws("|", "capture", "flow_id", F.col("end_s").cast("string"))
    return F.concat(F.lit("IDS-ALERT-"), F.substring(F.sha2(key, 256), 1, 16))


def build_alerts(scored: DataFrame, method: str = "rules") -> DataFrame:
    """Nested alert records of everything above LOW."""
    kept = score_alerts(scored).filter(F.col("severity") != "LOW")

    def share(flag: str) -> Column:
        return F.bround(F.col(flag) / F.greatest(F.lit(1), F.col("packets")), 2)

    by_model = F.col("prediction") == 1
    return kept.select(
        utc_text("end_s").alias("timestamp"),
        alert_id().alias("alert_id"),
        F.lit(ALERT_CATEGORY).alias("threat_category"),
        "severity",
        F.when(by_model, F.lit(f"ML Inference ({method})"))
        .otherwise(F.lit("Behavioral Heuristics"))
        .alias("detection_method"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("dst_port").alias("target_port"),
        protocol_name("proto").alias("protocol"),
        F.struct(
            F.col("packets"),
            F.bround("duration_s", 4).alias("duration_seconds"),
            share("syn").alias("syn_ratio"),
            share("rst").alias("rst_ratio"),
        ).alias("flow_statistics"),
        F.struct(
            F.bround("host_port_entropy", 3).alias("port_entropy"),
            F.col("host_dst_diversity").cast("int").alias("destination_diversity"),
            F.bround("host_failed_flow_ratio", 2).alias("failed_flow_ratio"),
        ).alias("host_context"),
        F.bround("alert_score", 4).alias("threat_confidence"),
        F.bround("drift_score", 2).alias("behavioral_drift_score"),
        F.col("drift_notes").alias("behavioral_explanation"),
        F.col("evidence").alias("trigger_evidence"),
        "capture",
        "end_s",
    )


def cool_down(
    alerts: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    quiet_s: float = DEFAULT.cooldown_s,
    limit: int = 200_000,
) -> DataFrame:
    """Alerts that pass: the first of a key, then the first more than ``quiet_s`` after
    the last one passed. Of alerts at one instant the smallest ``tie`` passes."""
    nodes = spaced_chain(alerts, keys, ts, quiet_s, inclusive=False, limit=limit)
    firsts = alerts.groupBy(*keys, ts).agg(F.min(tie).alias(tie))
    passed = nodes.withColumnRenamed("node", ts).join(firsts, [*keys, ts])
    return alerts.join(passed, [*keys, ts, tie], "left_semi")


def latest(alerts: DataFrame, ts: str, tie: str, n: int = 1000) -> DataFrame:
    return alerts.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
