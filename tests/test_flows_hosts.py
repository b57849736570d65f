"""Hand-checked scenarios of flow assembly, host windows and feature tables."""

from __future__ import annotations

import math

import pytest
from traffic import background, syn_scan
from pyspark.sql import functions as F

from scoutlake.operators.flows import assemble_flows
from scoutlake.operators.hosts import feature_table, host_profiles
from scoutlake.operators.labels import label_by_scanners, label_flows
from scoutlake.operators.threat import INCIDENT_KEY, incident_documents, incident_evidence
from scoutlake.plans.analysis import incident_table


def hosts_of(packets, **kw):
    flows = assemble_flows(packets)
    return {r["src_ip"]: r for r in host_profiles(packets, flows, **kw).collect()}


def smoke():
    rows = []
    for i in range(10):
        t = i * 0.2
        rows += [
            (t, "192.168.1.100", 45000 + i, "8.8.8.8", 80, 6, 20, "S"),
            (t + 0.05, "8.8.8.8", 80, "192.168.1.100", 45000 + i, 6, 20, "SA"),
            (t + 0.1, "192.168.1.100", 45000 + i, "8.8.8.8", 80, 6, 20, "A"),
        ]
    rows.sort()
    rows += [(5 + 0.5 * i, "192.168.1.187", 38200 + i, "192.168.1.5", 20 + i, 6, 20, "S") for i in range(25)]
    return rows


def test_smoke_scenario(spark, packets):
    p = packets(smoke())
    flows = assemble_flows(p)
    assert p.count() == 55 and flows.count() == 35
    scanner = hosts_of(p)["192.168.1.187"]
    assert scanner["host_port_entropy"] == pytest.approx(math.log2(25))
    assert scanner["host_failed_flow_ratio"] == 1.0 and scanner["host_syn_ratio"] == 1.0
    assert scanner["host_packet_rate"] == pytest.approx(25 / 12)
    feats = feature_table(p, flows)
    listed = spark.createDataFrame([("192.168.1.187",)], "src_ip string")
    assert label_by_scanners(feats, listed).groupBy("label").count().orderBy("label").collect() == [(0, 10), (1, 25)]
    assert label_flows(feats).filter("label = 1").count() == 25
    assert label_flows(feats, listed).filter("label = 1").count() == 25
    few = incident_table(p).filter("src_ip = '192.168.1.187'")
    assert few.count() == 0
    one = incident_table(p, min_packets=1).filter("src_ip = '192.168.1.187'").collect()
    assert len(one) == 1 and one[0]["flow_count"] == 25
    assert one[0]["dst_port"] == "20, 21, 22, 23, 24 (+20 more)"


def test_incident_evidence_is_whole_as_rows_and_bounded_in_records(spark):
    """One incident of 3000 reports: every distinct text is a row; a record shows the first."""
    rows = [("c", "a", "b", "Scan", 10.0, f"text {k % 2500:04d}", "common") for k in range(3000)]
    rows += [("c", "a", "b", "Scan", 99.0, "late", "common"), ("c", "x", "y", "Scan", 5.0, None, None)]
    anchored = spark.createDataFrame(rows, "capture string, src_ip string, dst_ip string, scan_category string, node double, e1 string, e2 string")
    anchored = anchored.selectExpr("* except (e1, e2)", "array_compact(array(e1, e2)) AS evidence")
    texts = incident_evidence(anchored)
    got = {(r.src_ip, r.start_epoch, r.evidence): r.flows for r in texts.collect()}
    assert len(got) == 2501 + 2 and got["a", 10.0, "common"] == 3000
    assert got["a", 10.0, "text 0000"] == 2 and got["a", 10.0, "text 2499"] == 1
    heads = anchored.select(*INCIDENT_KEY, anchored.node.alias("start_epoch")).distinct()
    for shown in (1, 40, 5000):
        records = {(r.src_ip, r.start_epoch): r for r in incident_documents(heads, texts, shown).collect()}
        for (src, at), r in records.items():
            whole = sorted(t for s, a, t in got if (s, a) == (src, at))
            assert r.evidence == whole[:shown] and r.evidence_more == len(whole[shown:])
        assert len(records) == 3 and records["x", 5.0].evidence == []


def test_syn_scan_next_to_background(packets):
    hosts = hosts_of(packets(sorted(syn_scan() + background())))
    scan = hosts["10.0.0.50"]
    assert scan["host_port_entropy"] == pytest.approx(3.321928094887362, abs=1e-9)
    assert scan["host_dst_entropy"] == 0.0 and math.copysign(1, scan["host_dst_entropy"]) == 1
    assert scan["host_packet_rate"] == pytest.approx(10 / 4.5)
    assert scan["host_interval_mean"] == pytest.approx(0.5) and scan["host_interval_var"] == pytest.approx(0)
    assert hosts["192.168.1.5"]["host_packet_rate"] == pytest.approx(10.0)
    shake = hosts["192.168.1.6"]
    assert shake["host_syn_ratio"] == 0.5 and shake["host_packet_rate"] == pytest.approx(10.0)


@pytest.mark.parametrize(
    ("flags", "proto", "size", "failed"), [("S", 6, 20, 1.0), ("F", 6, 20, 0.0), ("FPU", 6, 20, 0.0), ("", 17, 8, 0.0)]
)
def test_probe_kinds(packets, flags, proto, size, failed):
    hosts = hosts_of(packets(syn_scan(flags=flags, proto=proto, size=size)))
    scan = hosts["10.0.0.50"]
    assert scan["host_port_entropy"] == pytest.approx(math.log2(10))
    assert scan["host_failed_flow_ratio"] == failed


def test_icmp_sweep_has_no_ports(packets):
    rows = [(0.2 * i, "10.0.0.50", 0, f"192.168.1.{i + 1}", 0, 1, 28, "") for i in range(14)]
    host = hosts_of(packets(rows))["10.0.0.50"]
    assert host["host_port_entropy"] == 0 and host["host_dst_diversity"] == 14
    assert host["host_dst_entropy"] == pytest.approx(math.log2(14))
    assert host["host_packet_rate"] == pytest.approx(14 / 2.6)
    assert host["host_icmp_ratio"] == 1.0 and host["host_interval_mean"] == pytest.approx(0.2)


def test_slow_scan_leaves_the_window(packets):
    rows = [*background(), *syn_scan(step=40.0, begin=10.0)]
    p = packets(rows)
    feats = feature_table(p, assemble_flows(p))
    scan = feats.filter("src_ip = '10.0.0.50'").select("host_port_entropy", "host_packet_rate").distinct().collect()
    assert [tuple(r) for r in scan] == [(0.0, 10.0)]
    old = feats.filter("src_ip = '192.168.1.6'").first()
    assert old["host_dst_diversity"] == 1.0 and old["host_packet_rate"] == 0.0


def test_timeout_boundary(packets):
    rows = [(t, "a", 1, "b", 2, 6, 20, "") for t in (0.0, 60.0, 120.000001)]
    flows = assemble_flows(packets(rows), timeout_s=60.0).orderBy("segment").collect()
    assert [(r["segment"], r["packets"]) for r in flows] == [(0, 2), (1, 1)]


def test_initiator_is_taken_per_segment(packets):
    rows = [(0.0, "a", 1, "b", 2, 6, 20, "S"), (100.0, "b", 2, "a", 1, 6, 30, "S"), (101.0, "a", 1, "b", 2, 6, 40, "A")]
    flows = assemble_flows(packets(rows), timeout_s=60.0).orderBy("segment").collect()
    assert [(r["src_ip"], r["fwd_bytes"], r["bwd_bytes"]) for r in flows] == [("a", 20, 0), ("b", 30, 40)]


@pytest.mark.parametrize("timeout", [None, 5.0])
def test_chunks_do_not_change_a_hot_flow(packets, timeout):
    """One flow holds most packets; cutting it into chunks gives the same table."""
    rows = []
    for i in range(600):
        hot = i % 3 != 0
        back = i % 5 == 0
        a, b = ("a", 1), ("b" if hot else f"c{i % 7}", 2)
        if back:
            a, b = b, a
        rows.append((i * 0.01 + (20 if i > 300 else 0), *a, *b, 6, 20 + i % 11, "SA"[i % 2]))
    p = packets(rows)

    def table(chunk):
        flows = assemble_flows(p, timeout_s=timeout, chunk_rows=chunk)
        return flows.select([F.round(c, 9).alias(c) if t == "double" else c for c, t in flows.dtypes])

    whole, cut = table(1 << 22), table(7)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0
    total = whole.agg(F.sum("packets"), F.sum(F.col("fwd_packets") + F.col("bwd_packets"))).first()
    assert tuple(total) == (600, 600)


def test_self_flow_counts_both_directions(packets):
    rows = [(0.0, "a", 1, "a", 2, 6, 20, "S"), (1.0, "a", 2, "a", 1, 6, 20, "SA")]
    host = hosts_of(packets(rows))["a"]
    assert host["host_packets"] == 2 and host["host_port_diversity"] == 2 and host["host_port_entropy"] == 1.0


def test_captures_stay_apart(packets):
    both = packets(syn_scan(), "one.pcap").unionByName(packets(syn_scan(begin=500.0), "two.pcap"))
    flows = assemble_flows(both)
    profiles = host_profiles(both, flows).collect()
    assert sorted((r["capture"], r["host_packets"]) for r in profiles) == [("one.pcap", 10), ("two.pcap", 10)]


def test_no_packets_gives_empty_tables(packets):
    p = packets([])
    flows = assemble_flows(p)
    assert flows.count() == 0 and feature_table(p, flows).count() == 0
