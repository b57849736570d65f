"""Queries: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.evaluation import RUN, predictions
from scoutlake.catalog.registry import query, rounded
from scoutlake.catalog.sql import r6
from scoutlake.operators import metrics as me
from scoutlake.operators import reports as re
from scoutlake.plans.analysis import reports
from scoutlake.session import stage
from scoutlake.sources.events_view import read_packets

HIT = "(prediction = 1 OR severity IN ('CRITICAL', 'HIGH', 'MEDIUM'))"


def _reports(spark, sf):
    return reports(read_packets(spark, sf))


@query(
    "r1_totals",
    f"SELECT count(*) AS sessions, count(*) FILTER {HIT} AS anomalies, {r6(f'anomaly_rate_pct=100.0 * count(*) FILTER {HIT} / count(*)')} FROM threat",
)
def r1(spark, sf):
    return rounded(re.totals(_reports(spark, sf)))


@query(
    "r2_severity_counts",
    f"""SELECT l.severity, count(t.flow_id) AS reports FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('SAFE')) l(severity)
        LEFT JOIN (SELECT * FROM threat WHERE {HIT}) t ON t.severity = l.severity GROUP BY l.severity""",
)
def r2(spark, sf):
    return re.severity_counts(_reports(spark, sf))


@query("r3_technique_counts", "SELECT technique, count(*) AS reports FROM (SELECT unnest(mitre) AS technique FROM threat) GROUP BY technique")
def r3(spark, sf):
    return re.technique_counts(_reports(spark, sf))


@query(
    "r4_scanner_summary",
    f"""SELECT src_ip, count(*) AS total_probes, {r6("max_score=max(threat_score)")}, arg_min(scan_category, (start_s, first_id)) AS category,
        len(list_distinct(list(dst_port))) AS port_count, array_to_string(list_sort(list_distinct(list(dst_port)))[1:15], ',') AS first_ports
        FROM threat GROUP BY src_ip""",
)
def r4(spark, sf):
    out = re.scanner_summary(stage(_reports(spark, sf), "reports"))
    text = F.concat_ws(",", F.transform("first_ports", lambda p: p.cast("string")))
    return rounded(out.withColumn("first_ports", text).withColumn("port_count", F.col("port_count").cast("bigint")))


@query("r5_threat_timeline", f"SELECT timestamp, {r6('threat_score=max(threat_score)')} FROM threat GROUP BY timestamp ORDER BY timestamp")
def r5(spark, sf):
    return rounded(re.timeline(_reports(spark, sf)))


@query("r6_counts_by_category", "SELECT scan_category, count(*) AS reports FROM threat GROUP BY scan_category")
def r6_category(spark, sf):
    return re.counts_by(_reports(spark, sf), "scan_category")


@query("r6_counts_by_source", "SELECT src_ip, count(*) AS reports FROM threat GROUP BY src_ip")
def r6_source(spark, sf):
    return re.counts_by(_reports(spark, sf), "src_ip")


@query(
    "r7_packets_per_second",
    """WITH line AS (SELECT unnest(range(671, 701)) AS second)
       SELECT second, count(p.pkt_id) AS packets FROM line LEFT JOIN (SELECT * FROM pkt WHERE 700 - ts_s <= 30) p ON floor(p.ts_s) = second GROUP BY second""",
)
def r7(spark, sf):
    return re.packets_per_second(read_packets(spark, sf), 700.0)


@query(
    "r8_newest_packets",
    """WITH m AS (SELECT *, count(*) OVER () AS matches, row_number() OVER (ORDER BY pkt_id DESC) AS rn FROM pkt WHERE proto = 6 AND
        (contains(src_ip, '21') OR contains(dst_ip, '21') OR contains(CAST(src_port AS VARCHAR), '21') OR contains(CAST(dst_port AS VARCHAR), '21')))
       SELECT matches - rn + 1 AS index, concat(strftime(to_timestamp(floor(ts_s)) AT TIME ZONE 'UTC', '%H:%M:%S'), '.', lpad(CAST(CAST(floor((ts_s % 1) * 1000) AS INT) AS VARCHAR), 3, '0')) AS time,
         src_ip, dst_ip, 'TCP' AS proto, src_port, dst_port, payload_len AS payload, CASE WHEN flags = '' THEN 'N/A' ELSE flags END AS tcp_flags,
         concat('TCP Flow: ', src_ip, ':', src_port, ' -> ', dst_ip, ':', dst_port, ' [Flags: ', flags, ']') AS summary, matches
       FROM m WHERE rn <= 100""",
)
def r8(spark, sf):
    return re.newest_packets(read_packets(spark, sf), "TCP", "21")


@query("r9_retained_packets", "SELECT pkt_id, src_ip, dst_ip FROM pkt ORDER BY pkt_id DESC LIMIT 5000")
def r9(spark, sf):
    return re.retained(read_packets(spark, sf)).select("pkt_id", "src_ip", "dst_ip")


@query(
    "r10_suspicious_sources",
    "SELECT DISTINCT src_ip FROM threat WHERE prediction = 1 OR severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') ORDER BY src_ip",
)
def r10(spark, sf):
    return re.suspicious_sources(_reports(spark, sf))


@query(
    "r11_risk_label",
    """SELECT CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL HAZARD' WHEN bool_or(severity IN ('HIGH', 'MEDIUM')) THEN 'HIGH RISK WARNING'
       ELSE 'CLEAN SECURE' END AS risk FROM threat""",
)
def r11(spark, sf):
    return re.risk_label(_reports(spark, sf))


@query(
    "r12_metric_table",
    """SELECT strategy, seed, upper(replace(model, '_', ' ')) AS model, printf('%.2f%%', accuracy * 100) AS accuracy, printf('%.2f%%', precision * 100) AS precision,
       printf('%.2f%%', recall * 100) AS recall, printf('%.2f%%', f1 * 100) AS f1, printf('%.4f', roc_auc) AS roc_auc FROM allmet""",
)
def r12(spark, sf):
    return re.metric_table(me.evaluate(predictions(spark, sf), RUN), ["strategy", "seed"])


@query("r14_summary_document")
def r14(spark, sf):
    from scoutlake.sources.captures import capture_metadata

    packets = read_packets(spark, sf)
    metadata = capture_metadata(packets).first().asDict()
    return re.summary_lines(stage(_reports(spark, sf), "reports"), metadata, "rules")
