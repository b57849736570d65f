"""Flow threat reports and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions.chains import latest_node, spaced_chain
from scoutlake.functions.exprs import compact_array, filled, fixed, protocol_name, total, utc_text
from scoutlake.params import DEFAULT

# Category names, rule confidence and MITRE ATT&CK techniques.
SYN_SCAN = "TCP SYN Stealth Reconnaissance"
FIN_SCAN = "TCP FIN Stealth Reconnaissance"
NULL_SCAN = "TCP NULL Stealth Reconnaissance"
SUBNET_SWEEP = "Subnet Discovery Sweep"
PORT_SWEEP = "Stealth Port Sweep"
STANDARD = "Standard Session"
CATEGORIES = {
    SYN_SCAN: (90.0, ["T1595 (Active Scanning)", "T1046 (Network Service Scanning)"]),
    FIN_SCAN: (100.0, ["T1595.002 (Active Scanning: Ports)", "T1046"]),
    NULL_SCAN: (100.0, ["T1595.002", "T1046"]),
    SUBNET_SWEEP: (80.0, ["T1595.001 (Active Scanning: IP Addresses)"]),
    PORT_SWEEP: (70.0, ["T1046 (Network Service Scanning)"]),
    STANDARD: (0.0, []),
}
# Lower bounds of the severities, worst first.
SEVERITY_BOUNDS = [("CRITICAL", 91.0), ("HIGH", 71.0), ("MEDIUM", 51.0), ("LOW", 26.0)]
SEVERITIES = [name for name, _ in SEVERITY_BOUNDS] + ["SAFE"]


def signatures(flows: DataFrame) -> DataFrame:
    """is_syn, is_fin, is_null from the flag counters."""
    silent = F.col("ack") == 0
    return flows.withColumns(
        {
            "is_syn": (F.col("syn") > 0) & silent,
            "is_fin": (F.col("fin") > 0) & (F.col("syn") == 0) & silent,
            "is_null": F.col("no_flags"),
        }
    )


def category() -> Column:
    suspicious = (F.col("prediction") == 1) | (F.col("host_port_entropy") > 2.0)
    return (
        F.when(~suspicious, F.lit(STANDARD))
        .when(F.col("is_syn"), F.lit(SYN_SCAN))
        .when(F.col("is_fin"), F.lit(FIN_SCAN))
        .when(F.col("is_null"), F.lit(NULL_SCAN))
        .when(F.col("host_dst_diversity") > 4, F.lit(SUBNET_SWEEP))
        .otherwise(F.lit(PORT_SWEEP))
    )


def _by_category(values: dict[str, Column], c: Column) -> Column:
    pairs = [x for name, v in values.items() for x in (F.lit(name), v)]
    return F.element_at(F.create_map(*pairs), c)


def rule_confidence(c: Column) -> Column:
    return _by_category({name: F.lit(conf) for name, (conf, _) in CATEGORIES.items()}, c)


def mitre(c: Column) -> Column:
    def techniques(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    return _by_category({name: techniques(t) for name, (_, t) in CATEGORIES.items()}, c)


def percent_cap(c: Column) -> Column:
    return F.least(F.lit(100.0), c)


def behavior_score() -> Column:
    return percent_cap(
        total(
            [
                F.col("host_port_entropy") * 15.0,
                F.col("host_dst_diversity") * 5.0,
                F.col("host_failed_flow_ratio") * 50.0,
            ]
        )
    )


def protocol_score() -> Column:
    odd = F.when(F.col("is_fin") | F.col("is_null"), 80.0).otherwise(0.0)
    half_open = F.when(F.col("is_syn"), 50.0).otherwise(0.0)
    shares = [F.col("host_proto_entropy") * 20.0, F.col("host_syn_ratio") * 30.0]
    return percent_cap(total([odd, half_open, *shares]))


def flow_score() -> Column:
    base = percent_cap(F.col("flow_syn_ack_ratio") * 50.0)
    short_probe = (F.col("packets") <= 3) & F.col("is_syn")
    return F.when(short_probe, F.greatest(base, F.lit(85.0))).otherwise(base)


def historical_score() -> Column:
    return percent_cap(F.abs("host_burstiness") * 50.0)


# Weights of the fused threat score.
WEIGHTS = {
    "ml_score": 0.30,
    "behavior_score": 0.20,
    "protocol_score": 0.20,
    "rule_confidence": 0.15,
    "flow_score": 0.10,
    "historical_score": 0.05,
}


def threat_score() -> Column:
    # Rounded so that component sums meeting a severity bound reach it.
    fused = F.round(total([F.col(n) * w for n, w in WEIGHTS.items()]), 9)
    quiet = F.col("scan_category") == STANDARD
    return F.when(quiet, F.least(fused, F.lit(25.0))).otherwise(fused)


def severity(score: Column) -> Column:
    out = F
    for name, bound in SEVERITY_BOUNDS:
        out = out.when(score >= bound, F.lit(name))
    return out.otherwise(F.lit("SAFE"))


# Evidence texts of a threat report.
EVIDENCE = {
    "by_model": "[Detection Rationale] ML engine '{model}' classified flow as anomalous with "
    "{confidence}% confidence. Final Threat Score: {score}/100.",
    "by_score": "[Detection Rationale] Heuristic threat score reached {score}/100, exceeding "
    "standard safe traffic thresholds.",
    "by_baseline": "[Detection Rationale] Traffic profile matches standard baseline "
    "(Threat Score: {score}/100).",
    "techniques": "[MITRE ATT&CK Mapping] Matches adversarial techniques: {names}.",
    "factors": "[Contributing Features] Anomalous behavioral indicators triggered: {names}.",
    "factor_entropy": "High Port Entropy ({value})",
    "factor_targets": "High Target Diversity ({value} IPs)",
    "factor_failures": "Elevated Connection Failure Ratio ({value}%)",
    "syn": "[Protocol Evidence] TCP SYN stealth scan signature detected (incomplete 3-way handshakes).",
    "fin": "[Protocol Evidence] TCP FIN packet detected without prior connection state "
    "(firewall bypass attempt).",
    "null": "[Protocol Evidence] TCP NULL packet detected (zero flags set; potential OS fingerprinting probe).",
    "mixed": "[Protocol Evidence] Protocol multiplexing or abnormal protocol usage detected (Entropy: {value}).",
    "flow": "[Flow Statistics] SYN/ACK Ratio: {ratio}. Total Packets in Flow: {packets}.",
    "bursty": "[Historical Deviation] Abnormal traffic burstiness detected (Index: {value}). "
    "Indicates sharp deviation from historical baseline flow rates.",
    "usual": "[Historical Deviation] Traffic burstiness (Index: {value}) remains within standard "
    "historical bounds.",
}


def evidence(model: str) -> Column:
    """Evidence texts that apply, in the order of EVIDENCE."""

    def say(key: str, **columns: Column) -> Column:
        return filled(EVIDENCE[key], **columns)

    score, burst = fixed(F.col("threat_score"), 1), F.abs("host_burstiness")
    entropy, targets = F.col("host_port_entropy"), F.col("host_dst_diversity")
    failed, mixed = F.col("host_failed_flow_ratio"), F.col("host_proto_entropy")
    factors = compact_array(
        [
            F.when(entropy > 2.0, say("factor_entropy", value=fixed(entropy, 2))),
            F.when(targets > 3, say("factor_targets", value=fixed(targets, 0))),
            F.when(failed > 0.5, say("factor_failures", value=fixed(failed * 100, 1))),
        ]
    )
    confidence = fixed(F.col("confidence") * 100, 1)
    rationale = (
        F.when(F.col("prediction") == 1, say("by_model", model=F.lit(model), confidence=confidence, score=score))
        .when(F.col("threat_score") > 25, say("by_score", score=score))
        .otherwise(say("by_baseline", score=score))
    )
    signature = (
        F.when(F.col("is_syn"), say("syn")).when(F.col("is_fin"), say("fin")).when(F.col("is_null"), say("null"))
    )
    return compact_array(
        [
            rationale,
            F.when(F.size("mitre_mappings") > 0, say("techniques", names=F.concat_ws(", ", "mitre_mappings"))),
            F.when(F.size(factors) > 0, say("factors", names=F.concat_ws(", ", factors))),
            signature,
            F.when(mixed > 1.0, say("mixed", value=fixed(mixed, 2))),
            say("flow", ratio=fixed(F.col("flow_syn_ack_ratio"), 2), packets=F.col("packets")),
            F.when(burst > 0.5, say("bursty", value=fixed(burst, 2))).otherwise(say("usual", value=fixed(burst, 2))),
        ]
    )


def threat_reports(scored: DataFrame, model: str = "rules") -> DataFrame:
    """One report per flow. Needs the 34 features, flow facts, prediction, confidence."""
    typed = signatures(scored).withColumn("scan_category", category())
    parts = typed.withColumns(
        {
            "rule_confidence": rule_confidence(F.col("scan_category")),
            "mitre_mappings": mitre(F.col("scan_category")),
            "ml_score": F.col("confidence") * 100.0,
            "behavior_score": behavior_score(),
            "protocol_score": protocol_score(),
            "flow_score": flow_score(),
            "historical_score": historical_score(),
        }
    )
    graded = parts.withColumn("threat_score", threat_score())
    return graded.withColumns(
        {
            "severity": severity(F.col("threat_score")),
            "timestamp": utc_text("start_s"),
            "protocol": protocol_name("proto", "Other"),
            "evidence": evidence(model),
        }
    )


def first_match_features(
    flows: DataFrame, features: DataFrame, names: list[str], order: str = "start_s"
) -> DataFrame:
    """Feature lookup that ignores the source port: flows sharing the other four fields
    all get the features of the first of them. Kept for comparison with tools that do
    this; ``threat_reports`` uses exact flow rows."""
    four = ["capture", "src_ip", "dst_ip", "dst_port", "proto"]
    first = features.groupBy(*four).agg(
        *[F.min_by(n, F.struct(order, "src_port")).alias(n) for n in names]
    )
    kept = [c for c in flows.columns if c not in names]
    return flows.select(*kept).join(first, four)


INCIDENT_KEY = ["capture", "src_ip", "dst_ip", "scan_category"]


def incident_anchors(
    reports: DataFrame, span_s: float = DEFAULT.incident_span_s, limit: int = 200_000
) -> DataFrame:
    """Reports with ``node``, the start of the incident they belong to: an incident is
    open for ``span_s`` from its first report, whatever follows in between."""
    nodes = spaced_chain(reports, INCIDENT_KEY, "start_s", span_s, inclusive=False, limit=limit)
    return latest_node(reports, nodes, INCIDENT_KEY, "start_s", span_s)


INCIDENT_ID = [*INCIDENT_KEY, "start_epoch"]


def incident_evidence(anchored: DataFrame) -> DataFrame:
    """(INCIDENT_ID, evidence, flows): one row per incident and distinct evidence text, with
    the number of reports that give it.

    Texts carry measured numbers, so a long incident may have as many as it has flows; they
    stay rows, counted before they are shuffled, and no task holds those of one incident.
    """
    texts = anchored.select(*INCIDENT_KEY, F.col("node").alias("start_epoch"), F.explode("evidence").alias("evidence"))
    return texts.groupBy(*INCIDENT_ID, "evidence").agg(F.count(F.lit(1)).alias("flows"))


def incident_documents(incident_rows: DataFrame, texts: DataFrame, shown: int = 1000, salts: int = 64) -> DataFrame:
    """Incidents as nested records for a sink: ``evidence`` holds the first ``shown`` texts
    in order, ``evidence_more`` counts the rest, which ``incident_evidence`` lists whole.

    The first texts are chosen within salted parts of an incident, then among those.
    """
    def first(rows: DataFrame, parts: list[str]) -> DataFrame:
        order = Window.partitionBy(*INCIDENT_ID, *parts).orderBy("evidence")
        return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= shown)

    single = texts.select(*INCIDENT_ID, "evidence").withColumn("_salt", F.pmod(F.xxhash64("evidence"), F.lit(salts)))
    kept = first(first(single, ["_salt"]), [])
    arrays = kept.groupBy(*INCIDENT_ID).agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))
    counts = texts.groupBy(*INCIDENT_ID).agg(F.count(F.lit(1)).alias("_texts"))
    none = F.array().cast("array<string>")
    return (
        incident_rows.join(counts, INCIDENT_ID, "left")
        .join(arrays, INCIDENT_ID, "left")
        .withColumn("evidence", F.coalesce("evidence", none))
        .withColumn("evidence_more", F.coalesce("_texts", F.lit(0)) - F.size("evidence"))
        .drop("_texts")
    )


def incidents(anchored: DataFrame) -> DataFrame:
    """Incident rows from anchored reports, ordered by start; their evidence is a table of
    its own, ``incident_evidence``."""
    key = [*INCIDENT_KEY, "node"]
    means = {
        n: F.avg(n).alias(n)
        for n in ["behavior_score", "protocol_score", "flow_score", "historical_score"]
    }
    core = anchored.groupBy(*key).agg(
        F.min("start_s").alias("start_epoch"),
        F.max("start_s").alias("end_epoch"),
        F.sum("packets").alias("packet_count"),
        F.count(F.lit(1)).alias("flow_count"),
        F.max("threat_score").alias("threat_score"),
        F.avg("confidence").alias("ml_confidence"),
        F.max("rule_confidence").alias("rule_confidence"),
        F.max("mitre_mappings").alias("mitre_mappings"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        *means.values(),
    )
    out = core.join(port_summary(anchored, key), key).withColumns(
        {
            "ml_prediction": (F.round("ml_confidence", 12) >= 0.5).cast("int"),
            "severity": severity(F.col("threat_score")),
            "timestamp": utc_text("start_epoch"),
            "protocol": F.concat_ws(", ", "protocols"),
            "mitre_mappings": F.array_sort("mitre_mappings"),
        }
    )
    return out.drop("node", "protocols").orderBy("start_epoch", "src_ip", "dst_ip", "scan_category")


def port_summary(rows: DataFrame, key: list[str], shown: int = 5) -> DataFrame:
    """(key, dst_port): the first ``shown`` ports in order, then how many more.

    Ports are ranked as rows; a port set is at most 65,536 values.
    """
    order = Window.partitionBy(*key).orderBy("port")
    ranked = (
        rows.select(*key, F.col("dst_port").alias("port"))
        .distinct()
        .withColumn("_rank", F.row_number().over(order))
    )
    first = F.array_sort(
        F.collect_list(F.when(F.col("_rank") <= shown, F.col("port")))
    )
    listed = ranked.groupBy(*key).agg(F.count("port").alias("_n"), first.alias("_first"))
    text = F.concat_ws(", ", F.transform("_first", lambda p: p.cast("string")))
    more = F.concat(F.lit(" (+"), F.col("_n") - shown, F.lit(" more)"))
    return listed.select(
        *key, F.when(F.col("_n") > shown, F.concat(text, more)).otherwise(text).alias("dst_port")
    )
