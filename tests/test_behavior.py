"""Profiles, drift, correlation: known answers and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scoutlake.functions.exprs import half_up
from scoutlake.operators import behavior as be
from scoutlake.operators import correlate as co
from scoutlake.operators.flows import assemble_flows
from scoutlake.params import Params
from scoutlake.plans import behavior as plan
from scoutlake.session import stage


def steady(src="10.0.0.1", seconds=400, dst="b", port=80, begin=0.0):
    return [(begin + i, src, 4000, dst, port, 6, 20, "A") for i in range(seconds + 1)]


def test_ticks_of_a_steady_host(packets):
    p = plan.build(packets(steady()), with_flows=False)
    ticks = p.ticks.orderBy("tick").collect()
    assert [r["tick"] for r in ticks] == [60.0, 120.0, 180.0, 240.0, 300.0, 360.0]
    assert {r["packet_count"] for r in ticks} == {61} and {r["elapsed"] for r in ticks} == {60.0}
    shots = be.snapshots(p.events, p.ticks, p.base).orderBy("timestamp").collect()
    assert [r["drift_score"] for r in shots[:4]] == [0.0] * 4
    rate, base = 301 / 300, 61 / 60
    assert shots[4]["drift_score"] == pytest.approx(20 * abs(rate - base) / base)


def test_packets_after_the_tick_wait_for_the_next(packets):
    """Of packets at the very instant of a tick only the first is counted by it."""
    rows = [*steady(seconds=60), *[(60.0, "10.0.0.1", 4000, "c", 81 + i, 6, 20, "A") for i in range(3)], *steady(seconds=60, begin=61.0)]
    p = plan.build(packets(rows), with_flows=False)
    first, second = p.ticks.orderBy("tick").collect()
    assert (first["tick"], first["packet_count"], first["destination_ip_count"]) == (60.0, 61, 1)
    # 60 .. 120: the four packets at 60 and one per second from 61 to 120.
    assert (second["tick"], second["packet_count"], second["destination_ip_count"]) == (120.0, 64, 2)


def test_protocol_baseline_moves_only_what_is_seen(spark):
    ticks = spark.createDataFrame(
        [("c", "h", 60.0, 1, 1.0, 1.0, 1, 1, 1, 0.0, {"6": 4}), ("c", "h", 120.0, 1, 1.0, 1.0, 1, 1, 1, 0.0, {"17": 4})],
        "capture string, src_ip string, tick double, packet_count bigint, packet_rate double, bytes_sec double, "
        "destination_ip_count bigint, destination_port_count bigint, session_count bigint, mean_session_duration double, "
        "protocol_usage map<string,bigint>",
    )
    last = be.baselines(ticks).orderBy("tick").collect()[-1]
    assert last["base_protocols"] == pytest.approx({"6": 2 / 3, "17": 1 / 3})


@pytest.mark.parametrize("cap", [1000, 5])
def test_running_threat(spark, cap):
    rng = random.Random(3)
    rows = [("c", "h", rng.uniform(0, 4), i, rng.random()) for i in range(40)]
    alerts = spark.createDataFrame(rows, "capture string, src_ip string, t double, i int, s double")
    got = be.running_threat(alerts, be.HOST, "t", "i", "s", cap=cap).orderBy("t", "i").collect()
    value = 0.0
    for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[3])), 1):
        value += (r[4] - value) / min(n, cap)
        assert got[n - 1]["value"] == pytest.approx(value)


def two_hosts(shift):
    rows = []
    for i in range(9):
        rows.append((i, "10.0.0.1", 1, f"b{i % 3}", 80 + i % 3, 6, 20, "A"))
        rows.append((i, "10.0.0.2", 1, f"{'b' if not shift else 'x'}{i % 3}", 80 + i % 3 + shift, 6, 20, "A"))
    return rows


def test_identical_hosts_correlate_fully(packets):
    p = plan.build(packets(two_hosts(0)), with_flows=False)
    drift = be.host_drift(p.events, p.base, p.as_of)
    pair = co.correlated_pairs(p.events, drift).collect()
    assert [(r["host_a"], r["host_b"], r["correlation_score"]) for r in pair] == [("10.0.0.1", "10.0.0.2", 1.0)]
    assert co.correlation_notes(co.correlated_pairs(p.events, drift)).count() == 2


def test_disjoint_hosts_do_not(packets):
    p = plan.build(packets(two_hosts(100)), with_flows=False)
    assert co.correlated_pairs(p.events, be.host_drift(p.events, p.base, p.as_of)).count() == 0


@pytest.mark.parametrize("popular", [1000, 3, 0])
@pytest.mark.parametrize("threshold", [0.55, 0.6, 0.8])
def test_pruning_loses_no_pair(spark, popular, threshold):
    """Candidates contain every pair whose Jaccard terms can reach the threshold."""
    rng = random.Random(11)
    sets = {}
    for h in range(40):
        ips = {f"i{rng.randint(0, 5)}" for _ in range(rng.randint(1, 6))} | ({f"r{h % 6}"} if h % 2 else set())
        ports = {rng.choice([80, 443, 22, *range(1000, 1010)]) for _ in range(rng.randint(1, 5))}
        sets[f"h{h:02}"] = (ips, ports)
    rows = [("c", h, "ip", v) for h, (ips, _) in sets.items() for v in ips]
    rows += [("c", h, "port", str(v)) for h, (_, ports) in sets.items() for v in ports]
    tokens = spark.createDataFrame(rows, "capture string, src_ip string, kind string, value string")
    got = {(r["host_a"], r["host_b"]) for r in co.candidate_pairs(tokens, threshold, popular).collect()}

    def jaccard(a, b):
        return len(a & b) / len(a | b)

    for a in sets:
        for b in sets:
            reach = 0.3 * jaccard(sets[a][0], sets[b][0]) + 0.2 * jaccard(sets[a][1], sets[b][1])
            if a < b and reach >= threshold - 0.5 + 1e-9:
                assert (a, b) in got
    pairs = co.shared_counts(co.candidate_pairs(tokens, threshold, popular), tokens).collect()
    for r in pairs:
        assert r["shared_dest_ips"] == len(sets[r["host_a"]][0] & sets[r["host_b"]][0])
        assert r["shared_ports"] == len(sets[r["host_a"]][1] & sets[r["host_b"]][1])


@pytest.mark.parametrize("most", [1000, 2])
def test_hosts_with_equal_sets_are_compared_once(spark, most):
    """Three kinds of hosts, 60 hosts: the sets of three (one of which is apart) are compared, whatever the hosts."""
    kinds = [({"a", "b"}, {"1", "2", "3"}), ({"a", "b"}, {"1", "2", "4"}), ({"x"}, {"9"})]
    rows = [("c", f"h{h:02}", k, v) for h in range(60) for k, vs in zip(("ip", "port"), kinds[h % 3], strict=True) for v in vs]
    tokens = spark.createDataFrame(rows, "capture string, src_ip string, kind string, value string")
    classes = co.host_classes(tokens, most)
    leaders = {r["src_ip"]: r["leader"] for r in classes.collect()}
    if most == 2:  # sets above the limit are classes of their own
        assert leaders == {f"h{h:02}": "h02" if h % 3 == 2 else f"h{h:02}" for h in range(60)}
        return
    assert leaders == {f"h{h:02}": f"h{h % 3:02}" for h in range(60)}
    got = {(r[1], r[2]): tuple(r[3:]) for r in co.class_pairs(tokens, classes, 0.6).collect()}
    assert set(got) == {("h00", "h00"), ("h00", "h01"), ("h01", "h00"), ("h01", "h01"), ("h02", "h02")}
    assert got["h00", "h01"][:2] == got["h01", "h00"][:2] == (2, 2) and got["h00", "h00"] == (2, 3, 0.5)
    assert got["h00", "h01"][2] == pytest.approx(0.3 + 0.2 * 2 / 4)


def alike_hosts(spark, n=24):
    """Events and drift of hosts of three kinds of sets in two captures, with many equal scores."""
    rng = random.Random(8)
    kinds = [({"a", "b"}, {1, 2, 3}), ({"a", "b"}, {1, 2, 4}), ({"x"}, {9})]
    usages = [{"6": 4}, {"6": 2, "17": 2}, {"1": 1, "6": 1, "17": 2}, {}]
    drift, events = [], []
    for h in range(n):
        host = ("c" if h % 5 else "d", f"h{h * 37 % n:02}")
        ips, ports = kinds[h % 3]
        events += [(*host, ip, port) for ip in sorted(ips) for port in sorted(ports)]
        drift.append((*host, rng.randint(0, 2), rng.randint(1, 2), len(ips), usages[rng.randint(0, 3)], float(rng.randint(0, 3))))
    schema = "capture string, src_ip string, packet_count bigint, destination_port_count bigint, destination_ip_count bigint, protocol_usage map<string,bigint>, drift_score double"
    return spark.createDataFrame(events, "capture string, src_ip string, dst_ip string, dst_port int"), spark.createDataFrame(drift, schema)


def scored_pairs(events, drift):
    """Every pair of hosts, by the definition."""
    sets, facts = {}, {(r[0], r[1]): r for r in drift.collect()}
    for r in events.collect():
        ips, ports = sets.setdefault((r[0], r[1]), (set(), set()))
        ips.add(r[2]), ports.add(r[3])

    def near(x, y):
        return 1 - abs(x - y) / max(x, y) if max(x, y) > 0 else 1.0

    out = {}
    for a in sets:
        for b in sets:
            if a[0] != b[0] or a[1] >= b[1]:
                continue
            (ia, pa), (ib, pb), fa, fb = sets[a], sets[b], facts[a], facts[b]
            ua, ub = fa["protocol_usage"], fb["protocol_usage"]
            gaps = [abs(ua.get(p, 0) / sum(ua.values()) - ub.get(p, 0) / sum(ub.values())) for p in {*ua, *ub}] if ua and ub else [2.0]
            near_all = 1 - sum(gaps) / 2 + sum(near(fa[c], fb[c]) for c in ["packet_count", "destination_port_count", "destination_ip_count", "drift_score"])
            score = 0.3 * len(ia & ib) / len(ia | ib) + 0.2 * len(pa & pb) / len(pa | pb) + 0.1 * near_all
            if round(score, 9) >= 0.6:
                out[a[0], a[1], b[1]] = round(score, 9)
    return out


@pytest.mark.parametrize("block, places", [(2, 32), (500, 32), (3, 1)])
def test_pairs_come_block_by_block(spark, monkeypatch, block, places):
    """Whatever the blocks and the way protocols are compared, the pairs and their values are those of the definition."""
    monkeypatch.setattr(co, "BLOCK_HOSTS", block)
    monkeypatch.setattr(co, "PLACED_PROTOCOLS", places)
    events, drift = alike_hosts(spark)
    got = co.correlated_pairs(events, drift).collect()
    want = scored_pairs(events, drift)
    assert {(r["capture"], r["host_a"], r["host_b"]): r["correlation_score"] for r in got} == pytest.approx(want)
    assert len(got) == len(want) > 40
    known = {(r["capture"], r["src_ip"]): r["drift_score"] for r in drift.collect()}
    assert all((known[r["capture"], r["host_a"]], known[r["capture"], r["host_b"]]) == (r["drift_score_a"], r["drift_score_b"]) for r in got)


def test_notes_keep_no_table_of_pairs(spark, monkeypatch):
    """The best partners among many equal ones, from a staged table of a row per host."""
    events, drift = alike_hosts(spark, 60)
    pairs, staged = co.correlated_pairs(events, drift), {}

    def counted(df, name):
        staged[name] = df.count()
        return stage(df, name)

    monkeypatch.setattr(co, "stage", counted)
    got = {(r["capture"], r["src_ip"]): r["note"] for r in co.correlation_notes(pairs).collect()}
    partners = {}
    for (c, a, b), score in scored_pairs(events, drift).items():
        partners.setdefault((c, a), []).append((-score, b))
        partners.setdefault((c, b), []).append((-score, a))

    def named(found):
        more = f" and {len(found) - 3} others" if len(found) > 3 else ""
        return co.NOTE.format(count=len(found), hosts=", ".join(h for _, h in sorted(found)[:3]) + more)

    assert got == {k: named(v) for k, v in partners.items()}
    assert max(len(v) for v in partners.values()) > 10 and staged == {"partners": len(partners)}


def test_half_up_is_round(spark):
    """Halves go up, as in ``F.round``: also those that doubles cannot hold."""
    rows = [((10 * k + 5) / 10**7,) for k in range(100, 1_000_000, 77)] + [(k / 1000,) for k in range(100_001)]
    table = spark.createDataFrame(rows, "x double")
    assert [table.filter(F.round("x", d) != half_up("x", d)).count() for d in (2, 6, 9)] == [0, 0, 0]


def test_low_thresholds_are_refused(spark):
    tokens = spark.createDataFrame([("c", "a", "ip", "x")], "capture string, src_ip string, kind string, value string")
    with pytest.raises(ValueError, match="every pair"):
        co.candidate_pairs(tokens, 0.5)


def test_timeline_has_every_host(packets):
    rows = sorted([*steady("10.0.0.1"), *steady("10.0.0.2", dst="c")])
    p = plan.build(packets(rows), with_flows=False)
    line = be.drift_timeline(p.events, p.base, params=Params()).collect()
    by = {h: sorted((r["time"], r["drift"]) for r in line if r["src_ip"] == h) for h in ("10.0.0.1", "10.0.0.2")}
    assert by["10.0.0.1"] == by["10.0.0.2"] and by["10.0.0.1"][0][0] == 0.0
    times = [t for t, _ in by["10.0.0.1"]]
    assert {b - a for a, b in zip(times, times[1:], strict=False)} == {6.0}


def test_empty_window_has_zero_stats(spark, packets):
    events = be.profile_events(packets(steady(seconds=5)))
    points = spark.createDataFrame([("t.pcap", "10.0.0.1", 1000.0)], "capture string, src_ip string, at double")
    got = be.stats_at(events, points, 300.0).first()
    assert got["packet_count"] == 0 and got["protocol_usage"] == {}
    assert events.filter(F.col("session_duration") > 0).count() == 0


def test_sweep_equals_stats_per_window(spark, packets, monkeypatch):
    """Same stats as window by window, silences and equal times included, from rows that do not
    grow with the overlap of the windows."""
    rng = random.Random(5)
    times = sorted([round(rng.uniform(0, 60), 2) for _ in range(150)] + [float(t) for t in range(0, 60, 6)] + [400.0, 400.0, 431.0])
    rows = [(t, f"10.0.0.{rng.randint(1, 3)}", 5, f"d{rng.randint(1, 4)}", rng.randint(80, 84), rng.choice([6, 17]), 20, "A") for t in times]
    table = packets(rows)
    events = be.profile_events(table, assemble_flows(table))
    nodes = [0.0, 6.0, 12.0, 30.0, 41.5, 60.0, 330.0, 400.0, 431.0]
    samples = spark.createDataFrame([("t.pcap", t, i) for i, t in enumerate(nodes)], "capture string, node double, idx int")
    hosts = events.select(*be.HOST).distinct()
    points = samples.join(hosts, "capture").select(*be.HOST, F.col("node").alias("at"), "idx")
    staged = {}

    def counted(df, name):
        staged[name] = df.count()
        return df

    monkeypatch.setattr(be, "stage", counted)
    got = be.swept_stats(events, points, samples, 30.0, 5.0)
    want = be.stats_at(events, points.drop("idx"), 30.0)
    names = ["packet_count", "destination_ip_count", "destination_port_count", "mean_session_duration", "protocol_usage"]

    def plain(df):
        return {(r["src_ip"], r["at"]): [pytest.approx(r[n]) if n == "mean_session_duration" else r[n] for n in names] for r in df.collect()}

    assert plain(got) == {k: [x.expected if hasattr(x, "expected") else x for x in v] for k, v in plain(want).items()}
    assert 0 < staged["swept"] <= len(rows)
