"""Alert score, threat score, prep and intel on hand-computed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scoutlake.functions import exprs as ex
from scoutlake.operators import alerts as al
from scoutlake.operators import audit as au
from scoutlake.operators import detect as de
from scoutlake.operators import intel as it
from scoutlake.operators import prep as pr
from scoutlake.operators import reports as re
from scoutlake.operators import threat as th
from scoutlake.schemas import FEATURES_20, REPUTATION


def row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


ALERT = {
    "prediction": 1, "confidence": 0.9, "host_port_entropy": 3.2, "host_failed_flow_ratio": 0.9,
    "host_dst_diversity": 5.0, "drift_score": 50.0,
}


def test_alert_score(spark):
    got = al.score_alerts(row(spark, **ALERT)).first()
    assert got["alert_score"] == pytest.approx(0.985) and got["severity"] == "HIGH"
    assert got["evidence"] == [
        "ML Model Classification (Confidence: 90.0%)",
        "Critical Destination Port Entropy (3.200)",
        "Severe Failed Connection Rate (90.0%)",
        "Moderate Subnet Target Diversity (5 hosts)",
        "Moderate Behavioral Drift Score (50.0/100)",
    ]


@pytest.mark.parametrize(("change", "severity"), [({"prediction": 0, "confidence": 0.0}, "MEDIUM"),
    ({"prediction": 0, "confidence": 0.0, "host_port_entropy": 2.0, "host_failed_flow_ratio": 0.5}, "LOW")])
def test_alert_severity(spark, change, severity):
    assert al.score_alerts(row(spark, **{**ALERT, **change})).first()["severity"] == severity


def test_drift_adjustment(spark):
    rows = spark.createDataFrame([(1, 0.1, 10.0), (1, 0.9, 61.0), (1, 0.5, 45.0), (0, 0.5, 10.0)], "p int, c double, d double")
    got = [round(r[0], 6) for r in rows.select(de.drift_adjusted(F.col("p"), F.col("c"), F.col("d"))).collect()]
    assert got == [0.0, 1.0, 0.5, 0.5]


THREAT = {
    "confidence": 0.95, "prediction": 1, "host_port_entropy": 4.643856, "host_dst_diversity": 1.0,
    "host_failed_flow_ratio": 1.0, "host_proto_entropy": 0.0, "host_syn_ratio": 1.0, "flow_syn_ack_ratio": 1.0,
    "host_burstiness": -1.0, "packets": 1, "syn": 1, "ack": 0, "fin": 0, "no_flags": False, "start_s": 0.0, "proto": 6,
}


def test_threat_score(spark):
    got = th.threat_reports(row(spark, **THREAT)).first()
    scores = [got[c] for c in ["behavior_score", "protocol_score", "flow_score", "historical_score", "rule_confidence"]]
    assert scores == [100.0, 80.0, 85.0, 50.0, 90.0]
    assert got["threat_score"] == pytest.approx(89.0) and got["severity"] == "HIGH"
    assert got["scan_category"] == th.SYN_SCAN and got["timestamp"] == "1970-01-01T00:00:00Z"
    assert got["evidence"][0].endswith("with 95.0% confidence. Final Threat Score: 89.0/100.")


def test_standard_session_is_capped(spark):
    quiet = {**THREAT, "prediction": 0, "host_port_entropy": 2.0}
    got = th.threat_reports(row(spark, **quiet)).first()
    assert got["scan_category"] == th.STANDARD and got["threat_score"] == 25.0 and got["severity"] == "SAFE"
    assert got["mitre_mappings"] == []


def test_fixed_text_rounds_ties_to_even(spark):
    values = spark.createDataFrame([(0.125,), (6.25,), (2.5,)], "x double")
    got = values.select(ex.fixed(F.col("x"), 2), ex.fixed(F.col("x"), 1), ex.fixed(F.col("x"), 0)).collect()
    assert [tuple(r) for r in got] == [("0.12", "0.1", "0"), ("6.25", "6.2", "6"), ("2.50", "2.5", "2")]


def test_fixed_text_is_of_the_binary_value(spark):
    values = [3.15, 0.35, 1.005, 2.675, 0.45, 8.45, 1e-7, 0.0, 99.95, 12345678.05, -3.15, 1e17]
    values += [k / 1000 for k in range(0, 4000, 5)]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in table.select(ex.fixed(F.col("x"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


CIC = {
    " Flow Duration": "2000000", "Total Fwd Packets": 3, " Total Backward Packets": 1, "Total Length of Fwd Packets": 30,
    " Total Length of Bwd Packets": 10, "SYN Flag Count": 1, "ACK Flag Count": 2, "RST Flag Count": 0, "FIN Flag Count": 0,
    "Packet Length Mean": "Infinity", "Packet Length Variance": 4.0, "Flow IAT Mean": 7.0, "Flow IAT Std": 3.0, " Label": " PortScan",
}


def test_cic_mapping(spark):
    got = pr.map_cic(row(spark, **CIC)).first()
    assert (got["flow_duration"], got["flow_packet_count"], got["flow_bytes"]) == (2.0, 4.0, 40.0)
    assert (got["flow_syn_ratio"], got["flow_size_mean"], got["flow_interval_var"]) == (0.25, 0.0, 9.0)
    assert (got["label"], got["attack_type"]) == (1, "PortScan")
    empty = pr.map_cic(row(spark, **{**CIC, "Total Fwd Packets": 0, " Total Backward Packets": 0, " Label": "BENIGN "})).first()
    assert empty["flow_syn_ratio"] == 0.0 and empty["label"] == 0


def test_mapping_coverage(spark):
    got = {r["dataset"]: tuple(r)[1:] for r in pr.mapping_coverage(pr.mapping_table(spark)).collect()}
    assert got == {"cic": (4, 6, 1, 9), "unsw": (1, 3, 3, 13)}


def test_name_sets():
    sizes = {c: len(pr.ablation_features(c)) for c in pr.ABLATIONS}
    assert list(sizes.values()) == [20, 16, 18, 11, 15, 19]
    assert len(pr.flow_only_features()) == 11


def test_packet_search(spark, packets):
    p = packets([(0, "10.0.0.1", 80, "10.0.0.2", 443, 6, 20, "SA"), (1, "10.0.0.9", 53, "10.0.0.2", 80, 17, 20, "")])
    assert pr.search_packets(p, "TCP").count() == 1
    assert pr.search_packets(p, "all", " sa ").count() == 1
    assert pr.search_packets(p, "UDP", "443").count() == 0


def test_audit_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "Port Scan"), (1, "a"), (1, None)], "n int, t string")
    assert tuple(au.profile(rows).first()) == (6, 2, 2, 3)
    flags = au.coverage(rows, "t", au.SCAN_WORDS).first()
    assert flags["has_port_scan"] and not flags["has_syn_scan"]


def test_intel(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("9.9.9.9",), ("any",), ("172.32.0.1",)], "ip string")
    known = spark.createDataFrame([("8.8.8.8", 80, 0, [53], "Isp", "Land", "feed")], REPUTATION)
    got = {r["ip"]: r for r in it.enrich(ips, known).collect()}
    assert got["10.1.2.3"]["blacklist_status"] == "SECURE" and got["10.1.2.3"]["is_private"]
    assert got["8.8.8.8"]["blacklist_status"] == it.CRITICAL and got["8.8.8.8"]["shodan_ports"] == [53]
    assert got["9.9.9.9"]["blacklist_status"] == it.CLEAN and got["any"]["blacklist_status"] == "CLEAN"
    assert not got["172.32.0.1"]["is_private"]
    rows = spark.createDataFrame([(1, "8.8.8.8"), (2, "8.8.8.8")], "id int, src_ip string")
    assert it.attach_intel(rows, known, "src_ip").select("intel.isp").distinct().collect() == [("Isp",)]


def test_summary_document(spark):
    reports = th.threat_reports(row(spark, **THREAT, src_ip="10.0.0.1", dst_port=22, first_id=1))
    text = re.summary_document(reports, {"file": "a.pcap"}, "rules")
    assert "`1 (100.0%)`" in text and "### `10.0.0.1`" in text and "- **HIGH:** `1`" in text


def test_summary_lists_all_hosts(spark):
    one = th.threat_reports(row(spark, **THREAT, src_ip="10.0.0.1", dst_port=22, first_id=1))
    name = F.concat(F.lit("10.0."), F.expr("id div 250"), F.lit("."), F.expr("id % 250"))
    many = one.crossJoin(spark.range(1200)).withColumn("src_ip", name).withColumn("threat_score", F.expr("50 + id % 7 * 0.5"))
    text = re.summary_document(many.drop("id"), {"file": "a.pcap"}, "rules").splitlines()
    hosts = [x[5:-1] for x in text if x.startswith("### ")]
    want = sorted((-(50 + k % 7 * 0.5), f"10.0.{k // 250}.{k % 250}") for k in range(1200))
    assert hosts == [x for _, x in want] and "- **Threat hosts:** `1200`" in text
    assert text[-2:] == ["- **Worst score:** `50.0`", "- **Target ports:** `1`, first `[22]`"]
    lines = re.summary_lines(many.drop("id"), {"file": "a.pcap"}, "rules")
    assert sorted(r["line"] for r in lines.collect()) == list(range(len(text)))


def test_missing_features_become_zero(spark):
    got = pr.with_missing(row(spark, flow_bytes=3.0), "lab").first()
    assert got["flow_bytes"] == 3.0 and sum(got[f] for f in FEATURES_20) == 3.0 and got["dataset_source"] == "lab"
