"""Queries: detection scores, alerts, threat reports, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.flows import ENDS_SQL
from scoutlake.catalog.registry import query, rounded
from scoutlake.catalog.sql import RULE_CONFIDENCE, r6
from scoutlake.functions.chains import spaced_chain
from scoutlake.operators import alerts as al
from scoutlake.operators import detect as de
from scoutlake.operators import threat as th
from scoutlake.plans.analysis import anchored_reports, incident_records, incident_table, reports
from scoutlake.plans.features import features, staged_flows
from scoutlake.session import stage
from scoutlake.sources.events_view import read_packets


def _scored(spark, sf, wide=False):
    scored = de.score_by_rules(features(read_packets(spark, sf), wide=wide))
    return scored.withColumn("drift_score", (F.col("first_id") * 37 % 101).cast("double"))


@query("c1_rule_classifier", f"SELECT flow_id, prediction, {r6('confidence')} FROM scored20")
def c1(spark, sf):
    return rounded(_scored(spark, sf), "flow_id", "prediction", "confidence")


@query(
    "c3_isolation_confidence",
    f"SELECT flow_id, {r6('confidence=least(1.0, greatest(0.0, (flow_syn_ratio - flow_ack_ratio) / 2 + 0.5))')} FROM f20",
)
def c3(spark, sf):
    anomaly = (F.col("flow_syn_ratio") - F.col("flow_ack_ratio")) / 2
    out = features(read_packets(spark, sf)).withColumn("confidence", de.isolation_confidence(anomaly))
    return rounded(out, "flow_id", "confidence")


@query(
    "c5_score_fusion",
    f"""SELECT flow_id, CAST(round(0.7 * flow_syn_ratio + 0.3 * {RULE_CONFIDENCE}, 12) >= 0.5 AS INT) AS prediction,
       {r6(f"confidence=0.7 * flow_syn_ratio + 0.3 * {RULE_CONFIDENCE}")} FROM f20""",
)
def c5(spark, sf):
    out = features(read_packets(spark, sf)).withColumns(de.fused(F.col("flow_syn_ratio")))
    return rounded(out, "flow_id", "prediction", "confidence")


@query(
    "c6_rule_fallback",
    f"""SELECT flow_id, CASE WHEN first_id % 2 = 0 THEN CAST(flow_syn_ratio >= 0.5 AS INT) ELSE prediction END AS prediction,
       round(CASE WHEN first_id % 2 = 0 THEN flow_syn_ratio ELSE confidence END, 6) + 0.0 AS confidence FROM scored20""",
)
def c6(spark, sf):
    feats = stage(features(read_packets(spark, sf)), "features")
    model = feats.filter("first_id % 2 = 0").select(
        "flow_id",
        (F.col("flow_syn_ratio") >= 0.5).cast("int").alias("prediction"),
        F.col("flow_syn_ratio").alias("confidence"),
    )
    return rounded(de.score_flows(feats, model, ["flow_id"]), "flow_id", "prediction", "confidence")


@query(
    "c7_drift_adjustment",
    f"""SELECT flow_id, {r6("confidence=CASE WHEN prediction = 1 AND drift_score < 30 THEN greatest(0.0, confidence - 0.15) "
      "WHEN prediction = 1 AND drift_score > 60 THEN least(1.0, confidence + 0.15) ELSE confidence END")} FROM scored20""",
)
def c7(spark, sf):
    scored = _scored(spark, sf)
    adjusted = de.drift_adjusted(F.col("prediction"), F.col("confidence"), F.col("drift_score"))
    return rounded(scored.withColumn("confidence", adjusted), "flow_id", "confidence")


@query("a1_a3_alert_score", f"SELECT flow_id, severity, {r6('alert_score')} FROM alert")
def a1(spark, sf):
    return rounded(al.score_alerts(_scored(spark, sf)), "flow_id", "severity", "alert_score")


@query("a2_alert_evidence", "SELECT flow_id, evidence FROM alert")
def a2(spark, sf):
    scored = al.score_alerts(_scored(spark, sf))
    return scored.select("flow_id", F.concat_ws("|", "evidence").alias("evidence"))


@query("a4_suppress_low", "SELECT severity, count(*) AS alerts FROM alert WHERE severity <> 'LOW' GROUP BY severity")
def a4(spark, sf):
    kept = al.build_alerts(_scored(spark, sf))
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "a5_alert_records",
    f"""SELECT strftime(to_timestamp(floor(end_s)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
       severity, CASE WHEN prediction = 1 THEN 'ML Inference (rules)' ELSE 'Behavioral Heuristics' END AS detection_method,
       src_ip AS source_ip, dst_ip AS destination_ip, dst_port AS target_port,
       CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(proto AS VARCHAR) END AS protocol,
       packets, round_even(duration_s, 4) + 0.0 AS duration_seconds, round_even(syn / packets, 2) + 0.0 AS syn_ratio,
       round_even(rst / packets, 2) + 0.0 AS rst_ratio, round_even(host_port_entropy, 3) + 0.0 AS port_entropy,
       CAST(host_dst_diversity AS INT) AS destination_diversity,
       round_even(host_failed_flow_ratio, 2) + 0.0 AS failed_flow_ratio,
       round_even(alert_score, 4) + 0.0 AS threat_confidence, round_even(drift_score, 2) + 0.0 AS behavioral_drift_score,
       evidence AS trigger_evidence FROM alert WHERE severity <> 'LOW'""",
)
def a5(spark, sf):
    kept = al.build_alerts(_scored(spark, sf))
    return kept.select(
        "timestamp", "severity", "detection_method", "source_ip", "destination_ip",
        "target_port", "protocol", "flow_statistics.*", "host_context.*", "threat_confidence",
        "behavioral_drift_score", F.concat_ws("|", "trigger_evidence").alias("trigger_evidence"),
    )


@query(
    "a6_alert_ids",
    "SELECT count(*) AS alerts, count(DISTINCT flow_id) AS distinct_ids FROM alert WHERE severity <> 'LOW'",
)
def a6(spark, sf):
    kept = al.build_alerts(_scored(spark, sf))
    return kept.agg(
        F.count(F.lit(1)).alias("alerts"), F.countDistinct("alert_id").alias("distinct_ids")
    )


@query(
    "a7_drift_notes_in_evidence",
    "SELECT flow_id, concat_ws('|', nullif(evidence, ''), CASE WHEN drift_score > 40 THEN concat('note ', src_ip) END) AS evidence FROM alert",
)
def a7(spark, sf):
    note = F.when(F.col("drift_score") > 40, F.array(F.concat(F.lit("note "), "src_ip")))
    scored = _scored(spark, sf).withColumn(
        "drift_notes", F.coalesce(note, F.array().cast("array<string>"))
    )
    return al.score_alerts(scored).select("flow_id", F.concat_ws("|", "evidence").alias("evidence"))


A8_SQL = """WITH RECURSIVE cand AS (
  SELECT src_ip, dst_ip, CASE proto WHEN 6 THEN 'tcp' ELSE 'other' END AS category, end_s, first_id FROM segflow),
chain AS (
  SELECT src_ip, dst_ip, category, min(end_s) AS t FROM cand GROUP BY ALL
  UNION ALL
  SELECT c.src_ip, c.dst_ip, c.category, min(b.end_s) FROM chain c JOIN cand b
  ON b.src_ip = c.src_ip AND b.dst_ip = c.dst_ip AND b.category = c.category AND b.end_s - c.t > 60
  GROUP BY c.src_ip, c.dst_ip, c.category, c.t)
SELECT b.src_ip, b.dst_ip, b.category, min(b.first_id) AS first_id, round(c.t, 6) AS end_s
FROM chain c JOIN cand b ON b.src_ip = c.src_ip AND b.dst_ip = c.dst_ip AND b.category = c.category AND b.end_s = c.t
GROUP BY b.src_ip, b.dst_ip, b.category, c.t"""


@query("a8_alert_cooldown", A8_SQL)
def a8(spark, sf):
    from scoutlake.operators.flows import assemble_flows

    flows = stage(assemble_flows(read_packets(spark, sf), timeout_s=60.0), "segments")
    alerts = flows.select(
        "src_ip", "dst_ip", "end_s", "first_id",
        F.when(F.col("proto") == 6, "tcp").otherwise("other").alias("category"),
    )
    passed = al.cool_down(alerts, ["src_ip", "dst_ip", "category"], "end_s", "first_id")
    return rounded(passed, "src_ip", "dst_ip", "category", "first_id", "end_s")


@query(
    "a9_latest_alerts",
    "SELECT flow_id, first_id FROM alert WHERE severity <> 'LOW' ORDER BY end_s DESC, first_id DESC LIMIT 1000",
)
def a9(spark, sf):
    kept = al.score_alerts(_scored(spark, sf)).filter("severity <> 'LOW'")
    return al.latest(kept, "end_s", "first_id").select("flow_id", "first_id")


@query(
    "t1_t3_categories",
    """SELECT flow_id, is_syn, is_fin, is_null, scan_category, CAST(rule_confidence AS DOUBLE) AS rule_confidence,
       array_to_string(mitre, '|') AS mitre_mappings FROM threat1""",
)
def t1(spark, sf):
    return reports(read_packets(spark, sf)).select(
        "flow_id", "is_syn", "is_fin", "is_null", "scan_category", "rule_confidence",
        F.concat_ws("|", "mitre_mappings").alias("mitre_mappings"),
    )


@query(
    "t4_t6_sub_scores",
    f"SELECT flow_id, {r6('behavior_score', 'protocol_score', 'flow_score', 'historical_score')} FROM threat1",
)
def t4(spark, sf):
    return rounded(
        reports(read_packets(spark, sf)),
        "flow_id", "behavior_score", "protocol_score", "flow_score", "historical_score",
    )


@query(
    "t7_first_match_lookup",
    f"""WITH m AS (SELECT src_ip, dst_ip, dst_port, proto, arg_min(host_port_entropy, (start_s, src_port)) AS e,
          arg_min(flow_syn_ratio, (start_s, src_port)) AS s FROM f20 GROUP BY ALL)
       SELECT f.flow_id, {r6("host_port_entropy=m.e", "flow_syn_ratio=m.s")} FROM flowname f JOIN m
       ON m.src_ip = f.src_ip AND m.dst_ip = f.dst_ip AND m.dst_port = f.dst_port AND m.proto = f.proto""",
)
def t7(spark, sf):
    feats = stage(features(read_packets(spark, sf)), "features")
    names = ["host_port_entropy", "flow_syn_ratio"]
    return rounded(th.first_match_features(feats, feats, names), "flow_id", *names)


@query(
    "t8_t9_threat_score",
    f"SELECT flow_id, severity, timestamp, protocol, {r6('threat_score')} FROM threat",
)
def t8(spark, sf):
    return rounded(
        reports(read_packets(spark, sf)), "flow_id", "severity", "timestamp", "protocol", "threat_score"
    )


T10_SQL = """SELECT flow_id, concat_ws('|',
  CASE WHEN prediction = 1 THEN printf('[Detection Rationale] ML engine ''rules'' classified flow as anomalous with %.1f%% confidence. Final Threat Score: %.1f/100.', confidence * 100, threat_score)
    WHEN threat_score > 25 THEN printf('[Detection Rationale] Heuristic threat score reached %.1f/100, exceeding standard safe traffic thresholds.', threat_score)
    ELSE printf('[Detection Rationale] Traffic profile matches standard baseline (Threat Score: %.1f/100).', threat_score) END,
  CASE WHEN len(mitre) > 0 THEN concat('[MITRE ATT&CK Mapping] Matches adversarial techniques: ', array_to_string(mitre, ', '), '.') END,
  CASE WHEN host_port_entropy > 2 OR host_dst_diversity > 3 OR host_failed_flow_ratio > 0.5 THEN
    concat('[Contributing Features] Anomalous behavioral indicators triggered: ', concat_ws(', ',
      CASE WHEN host_port_entropy > 2 THEN printf('High Port Entropy (%.2f)', host_port_entropy) END,
      CASE WHEN host_dst_diversity > 3 THEN printf('High Target Diversity (%.0f IPs)', host_dst_diversity) END,
      CASE WHEN host_failed_flow_ratio > 0.5 THEN printf('Elevated Connection Failure Ratio (%.1f%%)', host_failed_flow_ratio * 100) END), '.') END,
  CASE WHEN is_syn THEN '[Protocol Evidence] TCP SYN stealth scan signature detected (incomplete 3-way handshakes).'
    WHEN is_fin THEN '[Protocol Evidence] TCP FIN packet detected without prior connection state (firewall bypass attempt).'
    WHEN is_null THEN '[Protocol Evidence] TCP NULL packet detected (zero flags set; potential OS fingerprinting probe).' END,
  CASE WHEN host_proto_entropy > 1 THEN printf('[Protocol Evidence] Protocol multiplexing or abnormal protocol usage detected (Entropy: %.2f).', host_proto_entropy) END,
  printf('[Flow Statistics] SYN/ACK Ratio: %.2f. Total Packets in Flow: %d.', flow_syn_ack_ratio, packets),
  CASE WHEN abs(host_burstiness) > 0.5 THEN printf('[Historical Deviation] Abnormal traffic burstiness detected (Index: %.2f). Indicates sharp deviation from historical baseline flow rates.', abs(host_burstiness))
    ELSE printf('[Historical Deviation] Traffic burstiness (Index: %.2f) remains within standard historical bounds.', abs(host_burstiness)) END
  ) AS evidence FROM threat"""


@query("t10_threat_evidence", T10_SQL)
def t10(spark, sf):
    return reports(read_packets(spark, sf)).select(
        "flow_id", F.concat_ws("|", "evidence").alias("evidence")
    )


def incident_sql(select: str, min_packets: int = 2) -> str:
    return f"""WITH RECURSIVE rep AS (SELECT * FROM threat WHERE packets >= {min_packets}),
chain AS (
  SELECT src_ip, dst_ip, scan_category, min(start_s) AS t FROM rep GROUP BY ALL
  UNION ALL
  SELECT c.src_ip, c.dst_ip, c.scan_category, min(r.start_s) FROM chain c JOIN rep r
  ON r.src_ip = c.src_ip AND r.dst_ip = c.dst_ip AND r.scan_category = c.scan_category AND r.start_s - c.t > 60
  GROUP BY c.src_ip, c.dst_ip, c.scan_category, c.t),
anchored AS (
  SELECT r.*, (SELECT max(c.t) FROM chain c WHERE c.src_ip = r.src_ip AND c.dst_ip = r.dst_ip
     AND c.scan_category = r.scan_category AND c.t <= r.start_s) AS node FROM rep r),
inc0 AS (
  SELECT src_ip, dst_ip, scan_category, node, min(start_s) AS start_epoch, max(start_s) AS end_epoch,
    CAST(sum(packets) AS BIGINT) AS packet_count, count(*) AS flow_count, max(threat_score) AS threat_score,
    avg(confidence) AS ml_confidence, max(rule_confidence) AS rule_confidence, avg(behavior_score) AS behavior_score,
    avg(protocol_score) AS protocol_score, avg(flow_score) AS flow_score, avg(historical_score) AS historical_score,
    list_sort(list_distinct(list(dst_port))) AS ports, array_to_string(list_sort(list_distinct(list(protocol))), ', ') AS protocol,
    array_to_string(list_sort(any_value(mitre)), '|') AS mitre_mappings
  FROM anchored GROUP BY src_ip, dst_ip, scan_category, node)
{select}"""


@query(
    "t11_incident_grouping",
    incident_sql("SELECT flow_id, scan_category, round(node, 6) AS node FROM anchored", 1),
)
def t11(spark, sf):
    staged = stage(reports(read_packets(spark, sf)), "reports")
    return rounded(th.incident_anchors(staged), "flow_id", "scan_category", "node")


INCIDENT_NUMBERS = [
    "start_epoch", "end_epoch", "threat_score", "ml_confidence", "rule_confidence",
    "behavior_score", "protocol_score", "flow_score", "historical_score",
]


@query(
    "t12_t14_incidents",
    incident_sql(f"""SELECT src_ip, dst_ip, scan_category, packet_count, flow_count, protocol, mitre_mappings,
  CAST(round(ml_confidence, 12) >= 0.5 AS INT) AS ml_prediction, {r6(*INCIDENT_NUMBERS)},
  CASE WHEN threat_score >= 91 THEN 'CRITICAL' WHEN threat_score >= 71 THEN 'HIGH'
     WHEN threat_score >= 51 THEN 'MEDIUM' WHEN threat_score >= 26 THEN 'LOW' ELSE 'SAFE' END AS severity,
  concat(array_to_string(ports[1:5], ', '), CASE WHEN len(ports) > 5 THEN concat(' (+', len(ports) - 5, ' more)') ELSE '' END) AS dst_port
FROM inc0"""),
)
def t12(spark, sf):
    inc = incident_table(read_packets(spark, sf)).withColumn(
        "mitre_mappings", F.concat_ws("|", "mitre_mappings")
    )
    return rounded(
        inc, "src_ip", "dst_ip", "scan_category", "packet_count", "flow_count", "protocol",
        "mitre_mappings", "ml_prediction", *INCIDENT_NUMBERS, "severity", "dst_port",
    )


INCIDENT_TEXTS = f""", evidences AS ({T10_SQL}),
texts AS (SELECT a.src_ip, a.dst_ip, a.scan_category, a.node AS start_epoch, a.flow_id,
    unnest(string_split(evidences.evidence, '|')) AS evidence FROM anchored a JOIN evidences USING (flow_id))"""


@query(
    "t12_incident_evidence",
    incident_sql(f"""{INCIDENT_TEXTS}
SELECT src_ip, dst_ip, scan_category, evidence, count(*) AS flows, {r6("start_epoch")} FROM texts
GROUP BY src_ip, dst_ip, scan_category, start_epoch, evidence"""),
)
def t12_evidence(spark, sf):
    texts = th.incident_evidence(anchored_reports(read_packets(spark, sf)))
    return rounded(texts, "src_ip", "dst_ip", "scan_category", "evidence", "flows", "start_epoch")


@query(
    "t12_incident_records",
    incident_sql(f"""{INCIDENT_TEXTS},
lists AS (SELECT src_ip, dst_ip, scan_category, start_epoch, list_sort(list_distinct(list(evidence))) AS evidence
  FROM texts GROUP BY ALL)
SELECT src_ip, dst_ip, scan_category, flow_count, {r6("start_epoch", "threat_score")},
  array_to_string(evidence[1:3], '|') AS evidence, greatest(0, len(evidence) - 3) AS evidence_more
FROM inc0 JOIN lists USING (src_ip, dst_ip, scan_category, start_epoch)"""),
)
def t12_records(spark, sf):
    records = incident_records(read_packets(spark, sf), shown=3)
    return rounded(
        records.withColumn("evidence", F.concat_ws("|", "evidence")),
        "src_ip", "dst_ip", "scan_category", "flow_count", "start_epoch", "threat_score", "evidence", "evidence_more",
    )


@query(
    "c4_fill_absent_features",
    f"""SELECT flow_id, {r6("confidence=" + RULE_CONFIDENCE)} FROM
      (SELECT * REPLACE (CASE WHEN first_id % 2 = 1 THEN 0.0 ELSE host_failed_flow_ratio END AS host_failed_flow_ratio) FROM f20)""",
)
def c4(spark, sf):
    from scoutlake.operators.prep import cleaned, with_missing
    from scoutlake.schemas import FEATURES_20

    gaps = features(read_packets(spark, sf)).withColumn(
        "host_failed_flow_ratio", F.when(F.col("first_id") % 2 == 0, F.col("host_failed_flow_ratio"))
    )
    return rounded(de.score_by_rules(cleaned(with_missing(gaps), FEATURES_20)), "flow_id", "confidence")
