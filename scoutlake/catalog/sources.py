"""Queries: sources and sinks, as round trips over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.evaluation import RUN, RUN_SQL, predictions
from scoutlake.catalog.prep import DATASET, TON_RAW, UNSW_RAW, derived
from scoutlake.catalog.registry import query, rounded, table
from scoutlake.catalog.sql import r6
from scoutlake.operators import alerts as al
from scoutlake.operators import detect as de
from scoutlake.operators import metrics as me
from scoutlake.operators.splits import host_split, split_statistics
from scoutlake.catalog.frames import capture_folder, frames_from_packets
from scoutlake.plans.analysis import reports
from scoutlake.plans.features import features
from scoutlake.schemas import UNSW_COLUMNS
from scoutlake.session import new_folder, stage
from scoutlake.sources import captures as ca
from scoutlake.sources import tables as ta
from scoutlake.sources.events_view import read_packets

PACKET_SQL = "src_ip, dst_ip, src_port, dst_port, proto, payload_len, flags"


@query("s2_header_projection", f"SELECT pkt_id, {PACKET_SQL} FROM pkt")
def s2(spark, sf):
    frames = stage(frames_from_packets(read_packets(spark, sf)), "frames")
    return ca.decode_frames(frames).drop("capture", "ts_s")


@query("s1_capture_scan", f"SELECT CAST(round(ts_s * 1000000) AS BIGINT) AS ts_us, {PACKET_SQL} FROM pkt")
def s1(spark, sf):
    folder = capture_folder(read_packets(spark, sf), 50_000)
    frames = ca.read_frames(spark, folder, range_bytes=1 << 18)
    return ca.decode_frames(frames).withColumn("ts_us", F.round(F.col("ts_s") * 1e6).cast("long")).drop("capture", "pkt_id", "ts_s")


@query("s3_csv_scan", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def s3(spark, sf):
    rows = table(spark, sf, "customer")
    path = new_folder(spark, "csv")
    rows.write.option("header", True).csv(path)
    return ta.read_csv(spark, path, rows.schema)


@query("s4_headerless_csv", "SELECT state, spkts, sbytes, attack_cat, label FROM unswraw")
def s4(spark, sf):
    raw = derived(spark, sf, UNSW_RAW)
    wide = raw.select(*[F.col(c) if c in raw.columns else F.lit("0").alias(c) for c in UNSW_COLUMNS])
    path = new_folder(spark, "unsw")
    wide.write.option("header", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return ta.read_unsw(spark, path).select("state", "spkts", "sbytes", "attack_cat", "label")


@query(
    "s5_partitioned_splits",
    "SELECT row_id, label FROM dset WHERE host IN (3, 7)",
)
def s5(spark, sf):
    rows = derived(spark, sf, DATASET)
    held = table(spark, sf, "nation").filter("n_nationkey IN (3, 7)").select(F.col("n_nationkey").alias("host"))
    path = new_folder(spark, "splits")
    ta.write_splits(host_split(rows, held, "host").withColumn("strategy", F.lit("host_wise")), path)
    return ta.read_split(spark, path, "host_wise", "test").select("row_id", "label")


@query("s6_csv_sink", "SELECT flow_id, severity, array_to_string(mitre, ', ') AS mitre_mappings FROM threat")
def s6(spark, sf):
    rows = reports(read_packets(spark, sf)).select("flow_id", "severity", "mitre_mappings", "evidence")
    path = new_folder(spark, "reports-csv")
    ta.write_csv(rows, path)
    back = ta.read_csv(spark, path)
    return back.select("flow_id", "severity", F.coalesce("mitre_mappings", F.lit("")).alias("mitre_mappings"))


@query(
    "s7_alert_lines",
    "SELECT src_ip AS source_ip, severity, packets, round_even(syn / packets, 2) + 0.0 AS syn_ratio FROM alert WHERE severity <> 'LOW'",
)
def s7(spark, sf):
    scored = de.score_by_rules(features(read_packets(spark, sf))).withColumn(
        "drift_score", (F.col("first_id") * 37 % 101).cast("double")
    )
    records = stage(al.build_alerts(scored), "alerts")
    path = new_folder(spark, "alert-lines")
    for severity in ["HIGH", "MEDIUM"]:
        ta.append_json(records.filter(F.col("severity") == severity), path)
    return spark.read.schema(records.schema).json(path).select("source_ip", "severity", "flow_statistics.packets", "flow_statistics.syn_ratio")


@query("s8_report_lines", f"SELECT flow_id, scan_category, {r6('threat_score')} FROM threat")
def s8(spark, sf):
    rows = reports(read_packets(spark, sf)).select("flow_id", "scan_category", "threat_score")
    path = new_folder(spark, "report-lines")
    ta.overwrite_json(rows, path)
    return rounded(spark.read.schema(rows.schema).json(path))


@query("s9_metric_documents", f"SELECT {RUN_SQL}, metric, {r6('value')} FROM longmet")
def s9(spark, sf):
    path = new_folder(spark, "metrics")
    ta.write_metrics(me.evaluate(predictions(spark, sf), RUN), path)
    long = ta.read_metrics(spark, f"{path}/run=*")
    return rounded(long.withColumn("seed", F.col("seed").cast("int")))


@query(
    "s10_report_document",
    """SELECT CAST(json_extract(d, '$."host_wise/test".total') AS BIGINT) AS test_total, CAST(json_extract(d, '$."host_wise/train".recon') AS BIGINT) AS train_recon
       FROM (SELECT json_object('host_wise/test', json_object('total', count(*) FILTER (host IN (3, 7))), 'host_wise/train', json_object('recon', count(*) FILTER (label = 1 AND host NOT IN (3, 7)))) AS d FROM dset)""",
)
def s10(spark, sf):
    rows = derived(spark, sf, DATASET)
    held = table(spark, sf, "nation").filter("n_nationkey IN (3, 7)").select(F.col("n_nationkey").alias("host"))
    split = host_split(rows, held, "host").withColumn("strategy", F.lit("host_wise"))
    path = new_folder(spark, "report")
    ta.write_report(ta.report_document(split_statistics(split, ["f1", "f2"]), ["strategy", "subset"]), path)
    text = spark.read.option("wholetext", True).text(path)

    def at(key, name):
        return F.get_json_object("value", f"$['host_wise/{key}'].{name}").cast("bigint")

    return text.select(at("test", "total").alias("test_total"), at("train", "recon").alias("train_recon"))


@query(
    "s11_netflow_slice",
    "SELECT Attack, count(*) AS rows FROM (SELECT * FROM tonraw ORDER BY row_id LIMIT 5000) WHERE Attack IN ('scanning', 'Benign') GROUP BY Attack",
)
def s11(spark, sf):
    ordered = derived(spark, sf, TON_RAW).orderBy("row_id")
    return ta.netflow_slice(ordered, 5000, ["scanning", "Benign"]).groupBy("Attack").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s12_capture_metadata",
    """SELECT count(*) AS total_packets, (SELECT count(DISTINCT ip) FROM (SELECT src_ip AS ip FROM pkt UNION ALL SELECT dst_ip FROM pkt)) AS unique_ips_count,
       count(*) FILTER (proto = 6) AS tcp, count(*) FILTER (proto = 17) AS udp, count(*) FILTER (proto NOT IN (6, 17)) AS other,
       round(arg_max(ts_s, pkt_id) - arg_min(ts_s, pkt_id), 6) AS duration_seconds,
       strftime(to_timestamp(floor(arg_min(ts_s, pkt_id))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') AS start_time_utc,
       strftime(to_timestamp(floor(arg_max(ts_s, pkt_id))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') AS end_time_utc FROM pkt""",
)
def s12(spark, sf):
    return rounded(ca.capture_metadata(read_packets(spark, sf)).drop("capture"))


@query("s13_file_hashes")
def s13(spark, sf):
    return ca.file_hashes(spark, sf, "*.parquet")


@query("q6_leading_bytes")
def q6(spark, sf):
    return ca.leading_bytes(spark, sf, "*.parquet").select("file", "status")


@query(
    "s15_union_of_tables",
    """SELECT row_id, label, 'lab' AS dataset, source FROM dset WHERE source = 'F' UNION ALL SELECT row_id, label, 'field', NULL FROM dset WHERE source IS DISTINCT FROM 'F'""",
)
def s15(spark, sf):
    rows = derived(spark, sf, DATASET)
    lab = rows.filter("source = 'F'").select("row_id", "label", F.lit("lab").alias("dataset"), "source")
    field = rows.filter("NOT source <=> 'F'").select("row_id", "label", F.lit("field").alias("dataset"))
    return ta.union_tables([lab, field])


