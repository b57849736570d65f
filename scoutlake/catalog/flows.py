"""Queries: flow assembly, flow features, host features, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.registry import query, rounded
from scoutlake.catalog.sql import KEYS, r6
from scoutlake.operators import flows as fl
from scoutlake.operators import hosts as ho
from scoutlake.operators import labels as la
from scoutlake.params import DEFAULT
from scoutlake.plans.features import features, labelled_features, staged_flows
from scoutlake.schemas import FEATURES_20, FEATURES_34
from scoutlake.sources.events_view import read_packets

ENDS = ["src_ip", "src_port", "dst_ip", "dst_port", "proto"]
ENDS_SQL = ", ".join(ENDS)


@query("f1_flow_key", f"SELECT pkt_id, {KEYS} FROM keyed")
def f1(spark, sf):
    return fl.with_flow_key(read_packets(spark, sf)).select("pkt_id", *KEYS.split(", "))


@query(
    "f2_flow_assembly",
    f"SELECT {ENDS_SQL}, packets, bytes, {r6('start_s', 'end_s')} FROM flow",
)
def f2(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf))
    return rounded(flows, *ENDS, "packets", "bytes", "start_s", "end_s")


@query(
    "f3_direction_split",
    f"""SELECT f.flow_id,
       count(*) FILTER (k.src_ip = f.src_ip AND k.src_port = f.src_port) AS fwd_packets,
       count(*) FILTER (NOT (k.src_ip = f.src_ip AND k.src_port = f.src_port)) AS bwd_packets,
       CAST(sum(CASE WHEN k.src_ip = f.src_ip AND k.src_port = f.src_port THEN k.payload_len ELSE 0 END) AS BIGINT) AS fwd_bytes,
       CAST(sum(CASE WHEN k.src_ip = f.src_ip AND k.src_port = f.src_port THEN 0 ELSE k.payload_len END) AS BIGINT) AS bwd_bytes
       FROM flowname f JOIN keyed k ON {" AND ".join(f"f.{c} = k.{c}" for c in KEYS.split(", "))}
       GROUP BY f.flow_id""",
)
def f3(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf))
    return flows.select("flow_id", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")


@query("f4_flag_counts", "SELECT flow_id, syn, ack, rst, fin, psh, no_flags FROM flowname")
def f4(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf))
    return flows.select("flow_id", "syn", "ack", "rst", "fin", "psh", "no_flags")


@query("f5_flow_duration", f"SELECT flow_id, {r6('duration_s')} FROM flowname")
def f5(spark, sf):
    return rounded(fl.assemble_flows(read_packets(spark, sf)), "flow_id", "duration_s")


@query(
    "f6_flow_timeout",
    f"""SELECT {ENDS_SQL}, segment, packets, bytes, syn, ack,
        {r6("start_s", "end_s", "interval_mean", "interval_var")} FROM segflow""",
)
def f6(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf), timeout_s=DEFAULT.flow_timeout_s)
    return rounded(
        flows, *ENDS, "segment", "packets", "bytes", "syn", "ack",
        "start_s", "end_s", "interval_mean", "interval_var",
    )


@query(
    "f7_active_flows",
    "SELECT src_ip, src_port, dst_ip, dst_port, proto, segment, packets FROM segflow "
    "WHERE start_s <= 360 AND end_s >= 300",
)
def f7(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf), timeout_s=DEFAULT.flow_timeout_s)
    return fl.active_flows(flows, 360.0, 60.0).select(*ENDS, "segment", "packets")


@query("f8_flow_id", "SELECT flow_id, packets FROM flowname")
def f8(spark, sf):
    return fl.assemble_flows(read_packets(spark, sf)).select("flow_id", "packets")


@query(
    "f9_flow_start_lookup",
    f"""SELECT p.pkt_id, round(coalesce(f.start_s, (SELECT arg_min(start_s, first_id) FROM flow)), 6) AS timestamp
    FROM pkt p LEFT JOIN flow f ON {" AND ".join(f"p.{c} = f.{c}" for c in ENDS)}""",
)
def f9(spark, sf):
    packets = read_packets(spark, sf)
    flows = staged_flows(packets)
    return rounded(
        fl.start_times(packets, flows, ["capture", *ENDS]), "pkt_id", "timestamp"
    )


@query(
    "g1_g4_flow_features",
    f"""SELECT flow_id, {r6("flow_packet_count", "flow_bytes", "flow_syn_ratio", "flow_ack_ratio",
        "flow_rst_ratio", "flow_fin_ratio", "flow_size_mean", "flow_size_var",
        "flow_interval_mean", "flow_interval_var")} FROM f20""",
)
def g1(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf))
    names = FEATURES_20[1:11]
    cols = ho.flow_feature_columns()
    return rounded(flows.select("flow_id", *[cols[n].alias(n) for n in names]))


@query(
    "g5_g7_flow_rates",
    f"""SELECT flow_id, {r6("flow_packets_per_sec", "flow_bytes_per_sec", "flow_syn_ack_ratio",
        "flow_tcp_syn", "flow_tcp_ack", "flow_tcp_rst", "flow_tcp_fin", "flow_tcp_psh")} FROM f34""",
)
def g5(spark, sf):
    flows = fl.assemble_flows(read_packets(spark, sf))
    cols = ho.flow_feature_columns()
    return rounded(flows.select("flow_id", *[c.alias(n) for n, c in list(cols.items())[11:]]))


@query("g8_features_20", f"SELECT flow_id, {r6(*FEATURES_20)} FROM f20")
def g8(spark, sf):
    return rounded(features(read_packets(spark, sf)), "flow_id", *FEATURES_20)


@query("g9_features_34", f"SELECT flow_id, {r6(*FEATURES_34)} FROM f34")
def g9(spark, sf):
    return rounded(features(read_packets(spark, sf), wide=True), "flow_id", *FEATURES_34)


def _windowed(spark, sf, sizes):
    return ho.flows_in_windows(staged_flows(read_packets(spark, sf)), sizes)


@query("h1_window_flows", "SELECT flow_id, packets FROM flowname WHERE NOT ((SELECT max(end_s) FROM flow) - end_s > 30)")
def h1(spark, sf):
    return _windowed(spark, sf, [30]).select("flow_id", "packets")


@query("h2_initiator_packets", f"SELECT host AS src_ip, {r6('ts_s')} FROM hpkt WHERE window_s = 30")
def h2(spark, sf):
    packets = read_packets(spark, sf)
    windowed = ho.flows_in_windows(staged_flows(packets), [30])
    return rounded(ho.initiator_times(packets, windowed), "src_ip", "ts_s")


@query(
    "h3_h4_entropy",
    f"SELECT host AS src_ip, dim, n AS distinct_values, {r6('entropy=e')} FROM hent WHERE window_s = 30",
)
def h3(spark, sf):
    ent = ho.dimension_entropy(ho.value_counts(_windowed(spark, sf, [30])))
    long = ent.select(
        "src_ip",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("dim"),
                        F.col(f"{d}_distinct").alias("distinct_values"),
                        F.col(f"{d}_entropy").alias("entropy"),
                    )
                    for d in ["ip", "port", "proto"]
                ]
            )
        ).alias("s"),
    ).select("src_ip", "s.*")
    return rounded(long.filter("distinct_values > 0"))


@query(
    "h5_diversity",
    f"SELECT src_ip, {r6('host_dst_diversity', 'host_port_diversity')} FROM host30",
)
def h5(spark, sf):
    ent = ho.dimension_entropy(ho.value_counts(_windowed(spark, sf, [30])))
    return ent.select(
        "src_ip",
        F.col("ip_distinct").cast("double").alias("host_dst_diversity"),
        F.col("port_distinct").cast("double").alias("host_port_diversity"),
    )


@query(
    "h6_h8_host_ratios",
    f"SELECT src_ip, {r6('host_syn_ratio', 'host_failed_flow_ratio', 'host_packet_rate=rate_20')} FROM host30",
)
def h6(spark, sf):
    packets = read_packets(spark, sf)
    hosts = ho.host_profiles(packets, staged_flows(packets))
    return rounded(hosts, "src_ip", "host_syn_ratio", "host_failed_flow_ratio", "host_packet_rate")


@query(
    "h9_attach_host_profile",
    f"SELECT flow_id, {r6(*FEATURES_20[11:])} FROM f20",
)
def h9(spark, sf):
    return rounded(features(read_packets(spark, sf)), "flow_id", *FEATURES_20[11:])


WINDOW_COLUMNS = [
    "host_port_entropy", "host_dst_entropy", "host_dst_diversity", "host_syn_ratio",
    "host_failed_flow_ratio", "host_interval_mean", "host_interval_var",
    "host_packet_size_var", "host_port_diversity", "host_proto_entropy",
]


@query(
    "h10_multi_scale_windows",
    f"""SELECT window_s, src_ip, host_packets, host_flows, {r6(*WINDOW_COLUMNS)},
        {r6("host_packet_rate=rate_20")} FROM hostall""",
)
def h10(spark, sf):
    packets = read_packets(spark, sf)
    hosts = ho.host_profiles(packets, staged_flows(packets), list(DEFAULT.window_sizes_s))
    return rounded(
        hosts, "window_s", "src_ip", "host_packets", "host_flows", *WINDOW_COLUMNS,
        "host_packet_rate",
    )


@query(
    "h11_h15_host_timing",
    f"""SELECT src_ip, {r6("host_interval_mean", "host_interval_var", "host_packet_size_var",
        "host_dns_ratio", "host_icmp_ratio", "host_burstiness", "host_session_duration")} FROM host30""",
)
def h11(spark, sf):
    packets = read_packets(spark, sf)
    hosts = ho.host_profiles(packets, staged_flows(packets), rate_floor=DEFAULT.rate_floor_34)
    return rounded(
        hosts, "src_ip", "host_interval_mean", "host_interval_var", "host_packet_size_var",
        "host_dns_ratio", "host_icmp_ratio", "host_burstiness", "host_session_duration",
    )


RULES_SQL = """((host_port_entropy > 2.0 AND host_failed_flow_ratio > 0.7 AND flow_syn_ratio > 0.5)
 OR (host_dst_diversity > 4 AND host_dst_entropy > 1.5 AND host_syn_ratio > 0.7)
 OR (flow_packet_count <= 2 AND flow_syn_ratio = 1.0 AND flow_ack_ratio = 0.0 AND host_port_entropy > 1.5))"""


@query(
    "l1_known_scanners",
    "SELECT flow_id, CAST(src_ip IN (SELECT DISTINCT h FROM evp WHERE u = 0) AS INT) AS label FROM flowname",
)
def l1(spark, sf):
    packets = read_packets(spark, sf)
    flows = staged_flows(packets)
    scanners = packets.filter("flags = 'S' AND dst_ip LIKE '192.168.1.%' AND src_port % 10 = 0")
    return la.label_by_scanners(flows, scanners).select("flow_id", "label")


@query("l2_heuristic_labels", f"SELECT flow_id, CAST({RULES_SQL} AS INT) AS label FROM f20")
def l2(spark, sf):
    return labelled_features(read_packets(spark, sf)).select("flow_id", "label")


@query(
    "l3_lab_log_labels",
    """SELECT c.c_custkey AS row_id, CASE WHEN n.n_nationkey % 2 = 0 THEN CAST(n.n_nationkey % 4 = 0 AS INT) END AS label,
       CASE WHEN n.n_nationkey % 2 = 0 THEN concat('attack_', n.n_regionkey) ELSE 'unknown' END AS attack_type
       FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey""",
)
def l3(spark, sf):
    log = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey % 2 = 0").selectExpr(
        "concat('capture_', n_nationkey, '.pcap') AS pcap_filename",
        "CAST(n_nationkey % 4 = 0 AS INT) AS label",
        "concat('attack_', n_regionkey) AS attack_type",
    )
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS row_id", "concat('capture_', c_nationkey, '.pcap') AS pcap_filename"
    )
    return la.label_from_log(rows, log).select("row_id", "label", "attack_type")


@query(
    "l4_attack_from_filename",
    "SELECT c_custkey AS row_id, replace(concat(lower(c_mktsegment), '_scan.pcap'), '.pcap', '') AS attack_type FROM customer",
)
def l4(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS row_id", "concat(lower(c_mktsegment), '_scan.pcap') AS pcap_filename"
    )
    return rows.select("row_id", la.attack_from_filename().alias("attack_type"))
