"""Shared DuckDB building blocks of the oracle queries.

Each entry of CTES is one named sub-query; ``with_ctes`` puts the ones a statement
needs in front of it. They are written independently of the Spark plans (joins back
to the packets, probability-form entropies) so that agreement means something.
"""

from __future__ import annotations

import re

KEYS = "ip_lo, ip_hi, port_lo, port_hi, proto"


def same_key(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in KEYS.split(", "))


def flag(letter: str) -> str:
    return f"contains(upper(flags), '{letter}')"


def r6(*pairs: str) -> str:
    """'name=expr' or 'name' items as rounded doubles that are never -0.0."""
    out = []
    for pair in pairs:
        name, _, expr = pair.partition("=")
        out.append(f"round(CAST({expr or name} AS DOUBLE), 6) + 0.0 AS {name}")
    return ", ".join(out)


CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id, user_id, CAST(user_id % 10 AS INT) AS u, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INT) AS k,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS ts_s
FROM events"""
CTES["evp"] = """
SELECT event_id AS pkt_id, ts_s, u,
       concat('10.0.', CAST(user_id // 250 AS VARCHAR), '.', CAST(user_id % 250 AS VARCHAR)) AS h,
       concat('192.168.1.', CAST(k % 5 AS VARCHAR)) AS d,
       CASE WHEN u = 8 THEN 0 ELSE CAST(40000 + user_id % 20000 AS INT) END AS hp,
       CASE u WHEN 0 THEN 20 + k WHEN 8 THEN 0 WHEN 9 THEN 53 ELSE 20 + k % 10 END AS dp,
       CASE u WHEN 9 THEN 17 WHEN 8 THEN 1 ELSE 6 END AS proto,
       20 + CAST(floor(value) AS INT) AS payload_len,
       CASE WHEN u IN (2, 8, 9) THEN '' WHEN u = 0 THEN 'S' WHEN u = 1 THEN 'F'
            WHEN event_type = 'signup' THEN 'S' WHEN event_type = 'view' THEN 'SA'
            WHEN event_type = 'click' THEN 'PA' WHEN event_type = 'purchase' THEN 'FA' ELSE 'R' END AS flags,
       (event_id % 3 = 0 AND u NOT IN (0, 1, 2)) AS back
FROM ev"""
CTES["pkt"] = """
SELECT pkt_id, ts_s,
       CASE WHEN back THEN d ELSE h END AS src_ip, CASE WHEN back THEN h ELSE d END AS dst_ip,
       CASE WHEN back THEN dp ELSE hp END AS src_port, CASE WHEN back THEN hp ELSE dp END AS dst_port,
       proto, payload_len, flags
FROM evp"""
CTES["keyed"] = """
SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS from_lo,
       CASE WHEN from_lo THEN src_ip ELSE dst_ip END AS ip_lo,
       CASE WHEN from_lo THEN dst_ip ELSE src_ip END AS ip_hi,
       CASE WHEN from_lo THEN src_port ELSE dst_port END AS port_lo,
       CASE WHEN from_lo THEN dst_port ELSE src_port END AS port_hi
FROM pkt"""


def _flow_body(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, arg_min(src_ip, pkt_id) AS src_ip, arg_min(dst_ip, pkt_id) AS dst_ip,
       arg_min(src_port, pkt_id) AS src_port, arg_min(dst_port, pkt_id) AS dst_port,
       min(pkt_id) AS first_id, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes,
       arg_min(ts_s, pkt_id) AS start_s, arg_max(ts_s, pkt_id) AS end_s,
       greatest(0.0, arg_max(ts_s, pkt_id) - arg_min(ts_s, pkt_id)) AS duration_s,
       count(*) FILTER (proto = 6 AND {flag("S")}) AS syn,
       count(*) FILTER (proto = 6 AND {flag("A")}) AS ack,
       count(*) FILTER (proto = 6 AND {flag("R")}) AS rst,
       count(*) FILTER (proto = 6 AND {flag("F")}) AS fin,
       count(*) FILTER (proto = 6 AND {flag("P")}) AS psh,
       proto = 6 AND count(*) FILTER (length(flags) > 0) = 0 AS no_flags,
       avg(payload_len) AS size_mean, var_pop(payload_len) AS size_var,
       coalesce(avg(gap), 0.0) AS interval_mean, coalesce(var_pop(gap), 0.0) AS interval_var
FROM {source} GROUP BY {keys}"""


CTES["stepped"] = f"""
SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY {KEYS} ORDER BY pkt_id) AS gap FROM keyed"""
CTES["flow"] = _flow_body("stepped", KEYS)
CTES["flowname"] = """
SELECT *, concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '/', proto) AS flow_id FROM flow"""
CTES["segmented"] = f"""
SELECT * EXCLUDE (gap), CASE WHEN gap > 60 THEN NULL ELSE gap END AS gap,
       CAST(sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END)
            OVER (PARTITION BY {KEYS} ORDER BY pkt_id) AS BIGINT) AS segment
FROM stepped"""
CTES["segflow"] = _flow_body("segmented", KEYS + ", segment")
CTES["wsize"] = "SELECT unnest([5, 15, 30, 60, 120]) AS window_s"
CTES["wflow"] = """
SELECT w.window_s, f.* FROM wsize w JOIN flow f
ON NOT ((SELECT max(end_s) FROM flow) - f.end_s > w.window_s)"""
CTES["hpkt"] = f"""
SELECT w.window_s, w.src_ip AS host, k.* FROM wflow w JOIN keyed k
ON {same_key("w", "k")} AND k.src_ip = w.src_ip"""
CTES["hval"] = """
SELECT window_s, host, 'ip' AS dim, dst_ip AS value FROM hpkt
UNION ALL SELECT window_s, host, 'port', CAST(dst_port AS VARCHAR) FROM hpkt WHERE proto IN (6, 17)
UNION ALL SELECT window_s, host, 'proto', CAST(proto AS VARCHAR) FROM hpkt"""
CTES["hprob"] = """
SELECT window_s, host, dim, value, count(*) AS c,
       CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY window_s, host, dim) AS p
FROM hval GROUP BY window_s, host, dim, value"""
CTES["hent"] = """
SELECT window_s, host, dim, count(*) AS n, 0.0 - sum(p * log2(p)) AS e
FROM hprob GROUP BY window_s, host, dim"""
CTES["hgap"] = """
SELECT window_s, host, var_pop(g) AS v, stddev_pop(g) AS s, avg(g) AS m FROM (
  SELECT window_s, host, ts_s - lag(ts_s) OVER (PARTITION BY window_s, host ORDER BY ts_s) AS g FROM hpkt)
GROUP BY window_s, host"""
CTES["hflow"] = """
SELECT window_s, src_ip AS host, count(*) AS flows, count(*) FILTER (syn > 0 AND ack = 0) AS failed
FROM wflow GROUP BY window_s, src_ip"""
CTES["htot"] = f"""
SELECT window_s, host, count(*) AS packets, count(*) FILTER ({flag("S")}) AS syn,
       count(*) FILTER (dst_port = 53) AS dns, count(*) FILTER (proto = 1) AS icmp,
       max(ts_s) - min(ts_s) AS span, var_pop(payload_len) AS size_var
FROM hpkt GROUP BY window_s, host"""
CTES["hostall"] = """
SELECT t.window_s, t.host AS src_ip,
       coalesce(po.e, 0.0) AS host_port_entropy, i.e AS host_dst_entropy,
       CAST(i.n AS DOUBLE) AS host_dst_diversity, t.syn / t.packets AS host_syn_ratio,
       f.failed / f.flows AS host_failed_flow_ratio,
       t.packets / greatest(0.1, t.span) AS rate_20, t.packets / greatest(0.0001, t.span) AS rate_34,
       coalesce(g.m, 0.0) AS host_interval_mean, coalesce(g.v, 0.0) AS host_interval_var,
       t.size_var AS host_packet_size_var, CAST(coalesce(po.n, 0) AS DOUBLE) AS host_port_diversity,
       pr.e AS host_proto_entropy, t.dns / t.packets AS host_dns_ratio, t.icmp / t.packets AS host_icmp_ratio,
       (coalesce(g.s, 0.0) - coalesce(g.m, 0.0))
         / greatest(0.0001, coalesce(g.s, 0.0) + coalesce(g.m, 0.0)) AS host_burstiness,
       t.span AS host_session_duration, t.packets AS host_packets, f.flows AS host_flows
FROM htot t JOIN hflow f USING (window_s, host)
LEFT JOIN hent po ON po.window_s = t.window_s AND po.host = t.host AND po.dim = 'port'
JOIN hent i ON i.window_s = t.window_s AND i.host = t.host AND i.dim = 'ip'
JOIN hent pr ON pr.window_s = t.window_s AND pr.host = t.host AND pr.dim = 'proto'
LEFT JOIN hgap g ON g.window_s = t.window_s AND g.host = t.host"""
CTES["host30"] = "SELECT * FROM hostall WHERE window_s = 30"
CTES["feat"] = """
SELECT f.*, f.duration_s AS flow_duration, CAST(f.packets AS DOUBLE) AS flow_packet_count,
       CAST(f.bytes AS DOUBLE) AS flow_bytes, f.syn / f.packets AS flow_syn_ratio,
       f.ack / f.packets AS flow_ack_ratio, f.rst / f.packets AS flow_rst_ratio,
       f.fin / f.packets AS flow_fin_ratio, f.size_mean AS flow_size_mean, f.size_var AS flow_size_var,
       f.interval_mean AS flow_interval_mean, f.interval_var AS flow_interval_var,
       f.packets / greatest(0.0001, f.duration_s) AS flow_packets_per_sec,
       f.bytes / greatest(0.0001, f.duration_s) AS flow_bytes_per_sec,
       f.syn / greatest(1, f.ack) AS flow_syn_ack_ratio,
       CAST(f.syn AS DOUBLE) AS flow_tcp_syn, CAST(f.ack AS DOUBLE) AS flow_tcp_ack,
       CAST(f.rst AS DOUBLE) AS flow_tcp_rst, CAST(f.fin AS DOUBLE) AS flow_tcp_fin,
       CAST(f.psh AS DOUBLE) AS flow_tcp_psh,
       coalesce(h.host_port_entropy, 0.0) AS host_port_entropy,
       coalesce(h.host_dst_entropy, 0.0) AS host_dst_entropy,
       coalesce(h.host_dst_diversity, 1.0) AS host_dst_diversity,
       coalesce(h.host_syn_ratio, 0.0) AS host_syn_ratio,
       coalesce(h.host_failed_flow_ratio, 0.0) AS host_failed_flow_ratio,
       coalesce(h.rate_20, 0.0) AS host_rate_20, coalesce(h.rate_34, 0.0) AS host_rate_34,
       coalesce(h.host_interval_mean, 0.0) AS host_interval_mean,
       coalesce(h.host_interval_var, 0.0) AS host_interval_var,
       coalesce(h.host_packet_size_var, 0.0) AS host_packet_size_var,
       coalesce(h.host_port_diversity, 0.0) AS host_port_diversity,
       coalesce(h.host_proto_entropy, 0.0) AS host_proto_entropy,
       coalesce(h.host_dns_ratio, 0.0) AS host_dns_ratio,
       coalesce(h.host_icmp_ratio, 0.0) AS host_icmp_ratio,
       coalesce(h.host_burstiness, 0.0) AS host_burstiness,
       coalesce(h.host_session_duration, 0.0) AS host_session_duration
FROM flowname f LEFT JOIN host30 h ON h.src_ip = f.src_ip"""
CTES["f20"] = "SELECT * EXCLUDE (host_rate_20, host_rate_34), host_rate_20 AS host_packet_rate FROM feat"
CTES["f34"] = "SELECT * EXCLUDE (host_rate_20, host_rate_34), host_rate_34 AS host_packet_rate FROM feat"

RULE_CONFIDENCE = """CAST(CASE WHEN host_port_entropy > 2.2 AND host_failed_flow_ratio > 0.8 THEN 0.95
  WHEN host_dst_diversity > 4 AND host_syn_ratio > 0.8 THEN 0.90 ELSE 0.0 END AS DOUBLE)"""


def _scored(source: str) -> str:
    return f"""
SELECT *, {RULE_CONFIDENCE} AS confidence, CAST({RULE_CONFIDENCE} > 0 AS INT) AS prediction,
       CAST((first_id * 37) % 101 AS DOUBLE) AS drift_score
FROM {source}"""


CTES["scored20"] = _scored("f20")
CTES["scored34"] = _scored("f34")
CTES["alert0"] = """
SELECT *, least(1.0, greatest(0.0, round(
    CASE WHEN prediction = 1 THEN confidence * 0.45 ELSE confidence * 0.1 END
  + CASE WHEN host_port_entropy > 3 THEN 0.2 WHEN host_port_entropy > 2 THEN 0.1 ELSE 0 END
  + CASE WHEN host_failed_flow_ratio > 0.8 THEN 0.2 WHEN host_failed_flow_ratio > 0.5 THEN 0.1 ELSE 0 END
  + CASE WHEN host_dst_diversity > 10 THEN 0.15 WHEN host_dst_diversity > 4 THEN 0.08 ELSE 0 END
  + CASE WHEN drift_score > 75 THEN 0.2 WHEN drift_score > 40 THEN 0.1 ELSE 0 END, 9))) AS alert_score
FROM scored20"""
CTES["alert"] = """
SELECT *, CASE WHEN alert_score >= 0.75 THEN 'HIGH' WHEN alert_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  concat_ws('|',
    CASE WHEN prediction = 1 THEN printf('ML Model Classification (Confidence: %.1f%%)', confidence * 100) END,
    CASE WHEN host_port_entropy > 3 THEN printf('Critical Destination Port Entropy (%.3f)', host_port_entropy)
         WHEN host_port_entropy > 2 THEN printf('Moderate Destination Port Entropy (%.3f)', host_port_entropy) END,
    CASE WHEN host_failed_flow_ratio > 0.8 THEN printf('Severe Failed Connection Rate (%.1f%%)', host_failed_flow_ratio * 100)
         WHEN host_failed_flow_ratio > 0.5 THEN printf('Elevated Failed Connection Rate (%.1f%%)', host_failed_flow_ratio * 100) END,
    CASE WHEN host_dst_diversity > 10 THEN printf('Critical Subnet Target Diversity (%d hosts)', CAST(host_dst_diversity AS INT))
         WHEN host_dst_diversity > 4 THEN printf('Moderate Subnet Target Diversity (%d hosts)', CAST(host_dst_diversity AS INT)) END,
    CASE WHEN drift_score > 75 THEN printf('Severe Behavioral Drift Score (%.1f/100)', drift_score)
         WHEN drift_score > 40 THEN printf('Moderate Behavioral Drift Score (%.1f/100)', drift_score) END) AS evidence
FROM alert0"""
CTES["threat0"] = """
SELECT *, syn > 0 AND ack = 0 AS is_syn, fin > 0 AND syn = 0 AND ack = 0 AS is_fin, no_flags AS is_null,
  CASE WHEN NOT (prediction = 1 OR host_port_entropy > 2.0) THEN 'Standard Session'
       WHEN syn > 0 AND ack = 0 THEN 'TCP SYN Stealth Reconnaissance'
       WHEN fin > 0 AND syn = 0 AND ack = 0 THEN 'TCP FIN Stealth Reconnaissance'
       WHEN no_flags THEN 'TCP NULL Stealth Reconnaissance'
       WHEN host_dst_diversity > 4 THEN 'Subnet Discovery Sweep'
       ELSE 'Stealth Port Sweep' END AS scan_category
FROM scored34"""
CTES["threat1"] = """
SELECT *,
  CASE scan_category WHEN 'TCP SYN Stealth Reconnaissance' THEN 90.0 WHEN 'TCP FIN Stealth Reconnaissance' THEN 100.0
    WHEN 'TCP NULL Stealth Reconnaissance' THEN 100.0 WHEN 'Subnet Discovery Sweep' THEN 80.0
    WHEN 'Stealth Port Sweep' THEN 70.0 ELSE 0.0 END AS rule_confidence,
  CASE scan_category WHEN 'TCP SYN Stealth Reconnaissance' THEN ['T1595 (Active Scanning)', 'T1046 (Network Service Scanning)']
    WHEN 'TCP FIN Stealth Reconnaissance' THEN ['T1595.002 (Active Scanning: Ports)', 'T1046']
    WHEN 'TCP NULL Stealth Reconnaissance' THEN ['T1595.002', 'T1046']
    WHEN 'Subnet Discovery Sweep' THEN ['T1595.001 (Active Scanning: IP Addresses)']
    WHEN 'Stealth Port Sweep' THEN ['T1046 (Network Service Scanning)'] ELSE [] END AS mitre,
  least(100.0, host_port_entropy * 15 + host_dst_diversity * 5 + host_failed_flow_ratio * 50) AS behavior_score,
  least(100.0, CASE WHEN is_fin OR is_null THEN 80 ELSE 0 END + CASE WHEN is_syn THEN 50 ELSE 0 END
      + host_proto_entropy * 20 + host_syn_ratio * 30) AS protocol_score,
  CASE WHEN packets <= 3 AND is_syn THEN greatest(85.0, least(100.0, flow_syn_ack_ratio * 50))
      ELSE least(100.0, flow_syn_ack_ratio * 50) END AS flow_score,
  least(100.0, abs(host_burstiness) * 50) AS historical_score
FROM threat0"""
CTES["threat2"] = """
SELECT *, CASE WHEN scan_category = 'Standard Session' THEN least(25.0, fusedscore) ELSE fusedscore END AS threat_score
FROM (SELECT *, round(0.30 * (confidence * 100) + 0.20 * behavior_score + 0.20 * protocol_score
   + 0.15 * rule_confidence + 0.10 * flow_score + 0.05 * historical_score, 9) AS fusedscore FROM threat1)"""
CTES["threat"] = """
SELECT *, CASE WHEN threat_score >= 91 THEN 'CRITICAL' WHEN threat_score >= 71 THEN 'HIGH'
     WHEN threat_score >= 51 THEN 'MEDIUM' WHEN threat_score >= 26 THEN 'LOW' ELSE 'SAFE' END AS severity,
  CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Other' END AS protocol,
  strftime(to_timestamp(floor(start_s)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM threat2"""


def with_ctes(body: str) -> str:
    """``body`` with every CTE it mentions (directly or through others) in front."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CTES and name not in seen:
                seen.add(name)
                need(CTES[name])
                order.append(name)

    need(body)
    body = body.strip()
    parts = [f"{name} AS ({CTES[name]})" for name in order]
    if not parts and not body.startswith("WITH "):
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return "WITH RECURSIVE " + ",\n".join([*parts, body[len(head) :]])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
