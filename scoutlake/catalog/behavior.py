"""Queries: behavioural profiles, drift, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.registry import query, rounded
from scoutlake.catalog.sql import CTES, KEYS, r6, same_key
from scoutlake.functions.exprs import half_up
from scoutlake.operators import behavior as be
from scoutlake.operators import correlate as co
from scoutlake.operators.flows import assemble_flows
from scoutlake.plans import behavior as plan
from scoutlake.plans.analysis import reports
from scoutlake.plans.features import features, staged_flows
from scoutlake.session import stage
from scoutlake.sources.events_view import read_packets

CTES["pe"] = f"""
SELECT k.src_ip, k.ts_s, k.pkt_id, k.payload_len, k.proto, k.dst_ip, k.dst_port,
  concat_ws('|', {", ".join("k." + c for c in KEYS.split(", "))}) AS session_id, greatest(0.0, k.ts_s - f.start_s) AS dur
FROM keyed k JOIN flow f ON {same_key("k", "f")}"""
CTES["clock"] = """
SELECT src_ip, 0 AS n, min(ts_s) AS t, CAST(NULL AS DOUBLE) AS prev FROM pe GROUP BY src_ip
UNION ALL
SELECT c.src_ip, c.n + 1, min(e.ts_s), c.t FROM clock c JOIN pe e ON e.src_ip = c.src_ip AND e.ts_s - c.t >= 60 GROUP BY c.src_ip, c.n, c.t"""
STATS = """count(*) AS packet_count, CAST(sum(e.payload_len) AS BIGINT) AS bytes_transferred, count(DISTINCT e.dst_ip) AS destination_ip_count,
  count(DISTINCT e.dst_port) AS destination_port_count, count(DISTINCT e.session_id) AS session_count,
  coalesce(avg(e.dur) FILTER (e.dur > 0), 0.0) AS mean_session_duration,
  count(*) FILTER (e.proto = 1) AS c1, count(*) FILTER (e.proto = 6) AS c6, count(*) FILTER (e.proto = 17) AS c17"""
CTES["tick"] = f"""
SELECT c.src_ip, c.n, c.t, c.t - c.prev AS elapsed, {STATS} FROM clock c JOIN pe e
ON e.src_ip = c.src_ip AND e.ts_s <= c.t AND e.ts_s >= c.t - floor(c.t - c.prev) WHERE c.n > 0 GROUP BY c.src_ip, c.n, c.t, c.prev"""
CTES["shares"] = """
SELECT src_ip, n, CAST(c1 AS DOUBLE) / packet_count AS p1, CAST(c6 AS DOUBLE) / packet_count AS p6, CAST(c17 AS DOUBLE) / packet_count AS p17 FROM tick WHERE n = 1
UNION ALL
SELECT src_ip, n, q1 / (q1 + q6 + q17), q6 / (q1 + q6 + q17), q17 / (q1 + q6 + q17) FROM (
  SELECT t.src_ip, t.n, CASE WHEN c1 > 0 THEN p1 + (c1 / packet_count - p1) / t.n ELSE p1 END AS q1,
    CASE WHEN c6 > 0 THEN p6 + (c6 / packet_count - p6) / t.n ELSE p6 END AS q6,
    CASE WHEN c17 > 0 THEN p17 + (c17 / packet_count - p17) / t.n ELSE p17 END AS q17
  FROM shares s JOIN tick t ON t.src_ip = s.src_ip AND t.n = s.n + 1)"""
_MEANS = {
    "base_packet_rate": "packet_count / elapsed",
    "base_bytes_sec": "bytes_transferred / elapsed",
    "base_destination_diversity": "destination_ip_count",
    "base_port_diversity": "destination_port_count",
    "base_session_count": "session_count",
    "base_session_duration": "mean_session_duration",
}
# The running mean is stepped the way it is defined, so truncated means agree too.
CTES["means"] = f"""
SELECT src_ip, n, {", ".join(f"CAST({x} AS DOUBLE) AS {m}" for m, x in _MEANS.items())} FROM tick WHERE n = 1
UNION ALL
SELECT t.src_ip, t.n, {", ".join(f"{m} + (CAST(1 AS DOUBLE) / t.n) * ({x} - {m})" for m, x in _MEANS.items())}
FROM means s JOIN tick t ON t.src_ip = s.src_ip AND t.n = s.n + 1"""
CTES["base"] = f"""
SELECT t.src_ip, t.n AS samples, t.t AS tick, {", ".join(_MEANS)}, p1, p6, p17
FROM tick t JOIN shares s ON s.src_ip = t.src_ip AND s.n = t.n JOIN means m ON m.src_ip = t.src_ip AND m.n = t.n"""


def moved(now: str, base: str) -> str:
    return f"(CASE WHEN {base} = 0 THEN CASE WHEN {now} > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, abs({now} - {base}) / {base}) END)"


DRIFT = f"""CASE WHEN samples >= 5 THEN least(100.0, round(20 * {moved("(packet_count / 300)", "base_packet_rate")}
 + 25 * {moved("destination_ip_count", "base_destination_diversity")} + 25 * {moved("destination_port_count", "base_port_diversity")}
 + 15 * least(1.0, (abs(coalesce(c1 / nullif(packet_count, 0), 0) - p1) + abs(coalesce(c6 / nullif(packet_count, 0), 0) - p6)
   + abs(coalesce(c17 / nullif(packet_count, 0), 0) - p17)) / 2)
 + 15 * {moved("mean_session_duration", "base_session_duration")}, 9)) ELSE 0.0 END"""
CTES["win300"] = f"""
SELECT b.src_ip, b.samples, {STATS} FROM base b JOIN pe e ON e.src_ip = b.src_ip AND e.ts_s BETWEEN b.tick - 300 AND b.tick GROUP BY b.src_ip, b.samples"""
CTES["snap"] = f"""
SELECT *, {DRIFT} AS drift_score FROM base JOIN win300 USING (src_ip, samples)"""
CTES["lastev"] = "SELECT max(ts_s) AS as_of FROM pe"
CTES["now300"] = f"""
SELECT e.src_ip, {STATS} FROM pe e JOIN lastev l ON e.ts_s >= l.as_of - 300 GROUP BY e.src_ip"""
CTES["lastbase"] = "SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY tick DESC) = 1"
_COUNTS = ["packet_count", "destination_ip_count", "destination_port_count", "session_count", "c1", "c6", "c17", "samples"]
_BASES = ["base_packet_rate", "base_destination_diversity", "base_port_diversity", "base_session_count", "base_session_duration", "p1", "p6", "p17"]
CTES["hostnow0"] = f"""
SELECT h.src_ip, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTS)}, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in [*_BASES, "mean_session_duration"])}
FROM (SELECT DISTINCT src_ip FROM pe) h LEFT JOIN now300 n ON n.src_ip = h.src_ip LEFT JOIN lastbase b ON b.src_ip = h.src_ip"""
CTES["hostnow"] = f"SELECT *, {DRIFT} AS drift_score FROM hostnow0"

STAT_COLUMNS = ["packet_count", "bytes_transferred", "destination_ip_count", "destination_port_count", "session_count"]


def _build(spark, sf):
    return plan.build(read_packets(spark, sf))


def _drift(p):
    return be.host_drift(p.events, p.base, p.as_of)


def _protocol_columns(df, usage="protocol_usage"):
    names = {"c1": "1", "c6": "6", "c17": "17"}
    return df.withColumns({n: F.coalesce(F.try_element_at(usage, F.lit(p)), F.lit(0)) for n, p in names.items()})


@query("b1_lifetime_totals", f"SELECT src_ip, {STATS.replace('e.', '')} FROM pe e GROUP BY src_ip".replace("coalesce(avg(dur) FILTER (dur > 0), 0.0) AS mean_session_duration,\n", ""))
def b1(spark, sf):
    packets = read_packets(spark, sf)
    totals = be.lifetime_totals(be.profile_events(packets, assemble_flows(packets)))
    return _protocol_columns(totals).select("src_ip", *STAT_COLUMNS, "c1", "c6", "c17")


@query(
    "b2_trailing_windows",
    f"""SELECT e.src_ip, w.name AS "window", packet_count, bytes_transferred, destination_ip_count, destination_port_count, session_count, c1, c6, c17,
        {r6("mean_session_duration")} FROM (SELECT e.src_ip, w.name, {STATS} FROM pe e JOIN (VALUES ('1m', 60), ('5m', 300), ('15m', 900), ('30m', 1800), ('1h', 3600)) w(name, size)
        ON e.ts_s >= (SELECT max(ts_s) FROM pe) - w.size GROUP BY e.src_ip, w.name) e, (SELECT 1) one, (SELECT 1) w0 JOIN (SELECT 1) w1 ON true""".replace(
        "SELECT e.src_ip, w.name AS", "SELECT e.src_ip, e.name AS").replace(", (SELECT 1) one, (SELECT 1) w0 JOIN (SELECT 1) w1 ON true", ""),
)
def b2(spark, sf):
    packets = read_packets(spark, sf)
    events = stage(be.profile_events(packets, assemble_flows(packets)), "events")
    as_of = events.agg(F.max("ts_s")).first()[0]
    stats = _protocol_columns(be.trailing_stats(events, as_of))
    return rounded(stats, "src_ip", "window", *STAT_COLUMNS, "c1", "c6", "c17", "mean_session_duration")


@query("b3_retention", "SELECT src_ip, count(*) AS events FROM pe WHERE ts_s >= (SELECT max(ts_s) FROM pe) - 120 GROUP BY src_ip")
def b3(spark, sf):
    events = be.profile_events(read_packets(spark, sf))
    as_of = events.agg(F.max("ts_s")).first()[0]
    return be.retained_events(events, as_of, 120.0).groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"))


@query(
    "b4_baseline_ticks",
    f"SELECT src_ip, packet_count, bytes_transferred, destination_ip_count, destination_port_count, session_count, {r6('tick=t', 'elapsed', 'mean_session_duration')} FROM tick",
)
def b4(spark, sf):
    return rounded(_build(spark, sf).ticks, "src_ip", *STAT_COLUMNS, "tick", "elapsed", "mean_session_duration")


@query(
    "b4_running_baseline",
    f"""SELECT src_ip, CAST(samples AS BIGINT) AS samples, {r6("tick", "base_packet_rate", "base_bytes_sec", "base_destination_diversity", "base_port_diversity",
        "base_session_count", "base_session_duration")} FROM base""",
)
def b4_baseline(spark, sf):
    return rounded(_build(spark, sf).base.drop("base_protocols", "capture"))


@query("b5_protocol_baseline", f"SELECT src_ip, CAST(samples AS BIGINT) AS samples, {r6('p1', 'p6', 'p17')} FROM base")
def b5(spark, sf):
    base = _build(spark, sf).base
    share = {n: F.coalesce(F.try_element_at("base_protocols", F.lit(p)), F.lit(0.0)) for n, p in [("p1", "1"), ("p6", "6"), ("p17", "17")]}
    return rounded(base.withColumns(share), "src_ip", "samples", "p1", "p6", "p17")


@query(
    "b6_snapshots",
    f"SELECT s.src_ip, {r6('timestamp=s.tick', 'packet_rate=t.packet_count / t.elapsed', 'drift_score', 'threat_score=0.0')}, t.destination_ip_count AS destination_diversity, "
    "t.destination_port_count AS port_diversity, CAST(s.samples AS BIGINT) AS samples FROM snap s JOIN tick t ON t.src_ip = s.src_ip AND t.n = s.samples",
)
def b6(spark, sf):
    p = _build(spark, sf)
    return rounded(be.snapshots(p.events, p.ticks, p.base).drop("capture"))


@query("b7_drift_score", f"SELECT src_ip, {r6('drift_score')} FROM hostnow")
def b7(spark, sf):
    return rounded(_drift(_build(spark, sf)), "src_ip", "drift_score")


def _note(name: str, now: str, base: str, whole: bool) -> str:
    shown = f"printf('%d', CAST({now} AS INT))" if whole else f"printf('%.1f', {now})"
    change = f"round(abs({now} / {base} - 1) * 100, 9)"
    by = (
        f"concat(' from ', CAST(trunc({base}) AS INT), ' to ', CAST({now} AS INT), '.')"
        if whole
        else f"printf(' by %.0f%%.', {change})"
    )
    return f"""CASE WHEN {base} = 0 AND {now} > 0 THEN concat('{name} appeared for the first time (currently ', {shown}, ').')
      WHEN {base} <> 0 AND {change} >= 20 THEN concat('{name}', CASE WHEN {now} / {base} > 1 THEN ' increased' ELSE ' decreased' END, {by}) END"""


_RATIO = "greatest(1.0, coalesce(packet_count / 300 / nullif(base_packet_rate, 0), 1.0), coalesce(destination_ip_count / nullif(base_destination_diversity, 0), 1.0), coalesce(destination_port_count / nullif(base_port_diversity, 0), 1.0))"


@query(
    "b8_drift_notes",
    f"""SELECT src_ip, CASE WHEN samples >= 5 THEN concat_ws('|', {_note("Packet rate", "(packet_count / 300)", "base_packet_rate", False)},
      {_note("Destination diversity", "destination_ip_count", "base_destination_diversity", True)}, {_note("Port diversity", "destination_port_count", "base_port_diversity", True)},
      CASE WHEN drift_score > 0 AND {_RATIO} > 2 THEN printf('Host behavior deviates %.1fx from its historical baseline.', {_RATIO})
           WHEN drift_score > 30 THEN printf('Host behavior deviates %.1fx from its historical baseline.', drift_score / 10) END) ELSE '' END AS notes FROM hostnow""",
)
def b8(spark, sf):
    drift = _drift(_build(spark, sf))
    return drift.select("src_ip", F.concat_ws("|", be.drift_notes()).alias("notes"))


@query(
    "b9_running_threat",
    f"SELECT flow_id, {r6('value=avg(threat_score) OVER (PARTITION BY src_ip ORDER BY start_s, first_id)')} FROM threat",
)
def b9(spark, sf):
    rows = stage(reports(read_packets(spark, sf)), "reports")
    out = be.running_threat(rows, be.HOST, "start_s", "first_id", "threat_score")
    return rounded(out, "flow_id", "value")


@query(
    "b10_flow_behavior",
    f"""SELECT f.flow_id, {r6("behavioral_drift_score=coalesce(drift_score, 0)", "historical_packet_rate=coalesce(base_packet_rate, 0)",
      "historical_destination_diversity=coalesce(base_destination_diversity, 0)",
      "historical_protocol_usage=coalesce((CASE WHEN p1 > 0 THEN 1 ELSE 0 END + CASE WHEN p6 > 0 THEN 1 ELSE 0 END + CASE WHEN p17 > 0 THEN 1 ELSE 0 END), 0)",
      "historical_session_count=coalesce(base_session_count, 0)", "historical_threat_score=0.0")} FROM flowname f LEFT JOIN hostnow h ON h.src_ip = f.src_ip""",
)
def b10(spark, sf):
    packets = read_packets(spark, sf)
    p = plan.build(packets)
    behavior = be.behavior_columns(_drift(p))
    out = be.attach_behavior(staged_flows(packets), behavior)
    return rounded(out, "flow_id", *be.FLOW_BEHAVIOR)


CTES["tok"] = "SELECT DISTINCT src_ip, 'ip' AS kind, dst_ip AS value FROM pe UNION SELECT DISTINCT src_ip, 'port', CAST(dst_port AS VARCHAR) FROM pe"
CTES["toksize"] = "SELECT src_ip, count(*) FILTER (kind = 'ip') AS ips, count(*) FILTER (kind = 'port') AS ports FROM tok GROUP BY src_ip"
CTES["tokshared"] = """
SELECT a.src_ip AS host_a, b.src_ip AS host_b, count(*) FILTER (a.kind = 'ip') AS shared_dest_ips, count(*) FILTER (a.kind = 'port') AS shared_ports
FROM tok a JOIN tok b ON a.kind = b.kind AND a.value = b.value AND a.src_ip < b.src_ip GROUP BY a.src_ip, b.src_ip"""


def alike(c: str) -> str:
    return f"(CASE WHEN greatest(a.{c}, b.{c}) > 0 THEN 1 - abs(a.{c} - b.{c}) / greatest(a.{c}, b.{c}) ELSE 1.0 END)"


_PROTO = " + ".join(f"abs(a.{c} / a.packet_count - b.{c} / b.packet_count)" for c in ["c1", "c6", "c17"])
CTES["pairs"] = f"""
SELECT s.*, a.drift_score AS drift_score_a, b.drift_score AS drift_score_b, round(0.3 * coalesce(shared_dest_ips / nullif(sa.ips + sb.ips - shared_dest_ips, 0), 0)
  + 0.2 * coalesce(shared_ports / nullif(sa.ports + sb.ports - shared_ports, 0), 0)
  + 0.1 * CASE WHEN a.packet_count > 0 AND b.packet_count > 0 THEN 1 - ({_PROTO}) / 2 ELSE 0.0 END
  + 0.1 * {alike("packet_count")} + 0.1 * {alike("destination_port_count")} + 0.1 * {alike("destination_ip_count")} + 0.1 * {alike("drift_score")}, 9) AS correlation_score
FROM tokshared s JOIN toksize sa ON sa.src_ip = s.host_a JOIN toksize sb ON sb.src_ip = s.host_b
JOIN hostnow a ON a.src_ip = s.host_a JOIN hostnow b ON b.src_ip = s.host_b"""
CTES["corr"] = "SELECT * FROM pairs WHERE correlation_score >= 0.6"
CTES["corrboth"] = """
SELECT host_a AS src_ip, host_b AS host, correlation_score, shared_dest_ips, shared_ports, drift_score_b AS drift FROM corr
UNION ALL SELECT host_b, host_a, correlation_score, shared_dest_ips, shared_ports, drift_score_a FROM corr"""


def _pairs(spark, sf, **kw):
    p = _build(spark, sf)
    return co.correlated_pairs(p.events, stage(_drift(p), "drift"), **kw)


def _six_digits(pairs):
    """``rounded`` for as many rows as pairs: their doubles have nine digits and lie between 0 and 100."""
    return pairs.withColumns({c: half_up(c, 6) for c, kind in pairs.dtypes if kind == "double"})


@query("b11_pair_correlation", f"SELECT host_a, host_b, shared_dest_ips, shared_ports, {r6('correlation_score')} FROM corr")
def b11(spark, sf):
    return _six_digits(_pairs(spark, sf)).select("host_a", "host_b", "shared_dest_ips", "shared_ports", "correlation_score")


@query("b12_correlated_hosts", f"SELECT src_ip, host, shared_dest_ips, shared_ports, {r6('correlation_score', 'drift', 'threat=0.0')} FROM corrboth")
def b12(spark, sf):
    hosts = co.correlated_hosts(_pairs(spark, sf))
    return _six_digits(hosts).select("src_ip", "host", "shared_dest_ips", "shared_ports", "correlation_score", "drift", "threat")


@query(
    "b13_correlation_notes",
    """WITH rk AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY correlation_score DESC, host) AS r, count(*) OVER (PARTITION BY src_ip) AS n FROM corrboth)
       SELECT src_ip, concat('Suspicious behavior is highly correlated with ', max(n), ' other host(s) (e.g., ', string_agg(host, ', ' ORDER BY r) FILTER (r <= 3),
       CASE WHEN max(n) > 3 THEN concat(' and ', max(n) - 3, ' others') ELSE '' END, '), indicating coordinated activity.') AS note FROM rk GROUP BY src_ip""",
)
def b13(spark, sf):
    return co.correlation_notes(_pairs(spark, sf)).select("src_ip", "note")


@query(
    "b14_most_abnormal",
    """SELECT h.src_ip, round(h.drift_score, 2) + 0.0 AS drift_score, t.session_count AS sessions, t.ips AS dest_diversity FROM hostnow h
       JOIN (SELECT src_ip, count(DISTINCT session_id) AS session_count, count(DISTINCT dst_ip) AS ips FROM pe GROUP BY src_ip) t ON t.src_ip = h.src_ip
       ORDER BY round(h.drift_score, 2) DESC, h.src_ip LIMIT 5""",
)
def b14(spark, sf):
    p = _build(spark, sf)
    return be.most_abnormal(_drift(p), be.lifetime_totals(p.events)).drop("capture")


CTES["smp"] = """
SELECT 1 AS one, min(ts_s) AS t FROM pe WHERE ts_s > 5 UNION ALL SELECT 1, min(e.ts_s) FROM smp s JOIN pe e ON e.ts_s - s.t > 5 GROUP BY s.t"""
CTES["smppt"] = """
SELECT s.t, b.src_ip, max(b.samples) AS samples FROM smp s JOIN base b ON b.tick <= s.t GROUP BY s.t, b.src_ip HAVING max(b.samples) >= 5"""
CTES["smpstat"] = f"""
SELECT p.src_ip, p.t, p.samples, {STATS} FROM smppt p JOIN pe e ON e.src_ip = p.src_ip AND e.ts_s BETWEEN p.t - 300 AND p.t GROUP BY p.src_ip, p.t, p.samples"""
CTES["smpdrift"] = f"SELECT *, {DRIFT} AS drift FROM smpstat JOIN base USING (src_ip, samples)"


@query(
    "b15_drift_timeline",
    f"""SELECT src_ip, {r6("time=t - min(t) OVER ()", "drift")} FROM smpdrift WHERE drift > 0""",
)
def b15(spark, sf):
    p = _build(spark, sf)
    return rounded(be.drift_timeline(p.events, p.base).drop("capture"))


@query(
    "b16_joint_intensity",
    "SELECT host_a, host_b, round(correlation_score, 2) + 0.0 AS correlation_score, shared_dest_ips, shared_ports, 0.0::DOUBLE AS joint_threat FROM corr",
)
def b16(spark, sf):
    return co.joint_intensity(_pairs(spark, sf)).drop("capture")


@query(
    "b17_current_vs_baseline",
    f"""SELECT src_ip, destination_ip_count AS destination_diversity, destination_port_count AS port_diversity, {r6("base_destination_diversity", "base_port_diversity",
       "packet_rate=packet_count / 300", "base_packet_rate", "session_duration=mean_session_duration", "base_session_duration")} FROM hostnow""",
)
def b17(spark, sf):
    return rounded(be.current_vs_baseline(_drift(_build(spark, sf))).drop("capture"))


@query(
    "r13_host_timeline",
    f"SELECT s.src_ip, {r6('timestamp=s.tick', 'packet_rate=t.packet_count / t.elapsed', 'drift_score', 'threat_score=0.0')} FROM snap s JOIN tick t ON t.src_ip = s.src_ip AND t.n = s.samples",
)
def r13(spark, sf):
    p = _build(spark, sf)
    shots = be.snapshots(p.events, p.ticks, p.base)
    return rounded(shots, "src_ip", "timestamp", "packet_rate", "drift_score", "threat_score")


def _features_with_behavior(spark, sf):
    packets = read_packets(spark, sf)
    return be.attach_behavior(features(packets), be.behavior_columns(_drift(plan.build(packets))))
