"""Table contracts."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("capture", T.StringType()),
        T.StructField("pkt_id", T.LongType()),
        T.StructField("ts_s", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("flags", T.StringType()),
    ]
)

# The canonical feature order models are trained on.
FLOW_FEATURES = [
    "flow_duration",
    "flow_packet_count",
    "flow_bytes",
    "flow_syn_ratio",
    "flow_ack_ratio",
    "flow_rst_ratio",
    "flow_fin_ratio",
    "flow_size_mean",
    "flow_size_var",
    "flow_interval_mean",
    "flow_interval_var",
]
HOST_FEATURES = [
    "host_port_entropy",
    "host_dst_entropy",
    "host_dst_diversity",
    "host_syn_ratio",
    "host_failed_flow_ratio",
    "host_packet_rate",
    "host_interval_mean",
    "host_interval_var",
    "host_packet_size_var",
]
FEATURES_20 = FLOW_FEATURES + HOST_FEATURES
FLOW_FEATURES_EXTRA = [
    "flow_packets_per_sec",
    "flow_bytes_per_sec",
    "flow_syn_ack_ratio",
    "flow_tcp_syn",
    "flow_tcp_ack",
    "flow_tcp_rst",
    "flow_tcp_fin",
    "flow_tcp_psh",
]
HOST_FEATURES_EXTRA = [
    "host_port_diversity",
    "host_proto_entropy",
    "host_dns_ratio",
    "host_icmp_ratio",
    "host_burstiness",
    "host_session_duration",
]
FEATURES_34 = FEATURES_20 + FLOW_FEATURES_EXTRA + HOST_FEATURES_EXTRA

# The 49 column names of the headerless UNSW-NB15 files.
UNSW_COLUMNS = (
    "srcip sport dstip dsport proto state dur sbytes dbytes sttl dttl sloss dloss "
    "service sload dload spkts dpkts swin dwin stcpb dtcpb smeansz dmeansz "
    "trans_depth res_bdy_len sjit djit stime ltime sintpkt dintpkt tcprtt synack "
    "ackdat is_sm_ips_ports ct_state_ttl ct_flw_http_mthd is_ftp_login ct_ftp_cmd "
    "ct_srv_src ct_srv_dst ct_dst_ltm ct_src_ltm ct_src_dport_ltm "
    "ct_dst_sport_ltm ct_dst_src_ltm attack_cat label"
).split()
UNSW = T.StructType([T.StructField(name, T.StringType()) for name in UNSW_COLUMNS])

LAB_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_host", T.StringType()),
        T.StructField("dst_host", T.StringType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("pcap_filename", T.StringType()),
        T.StructField("packet_count", T.IntegerType()),
        T.StructField("flow_count", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("sha256", T.StringType()),
    ]
)

METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc"]
RUN_METRICS = T.StructType(
    [
        T.StructField("strategy", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("validation_f1", T.DoubleType()),
        T.StructField(
            "test_metrics",
            T.StructType(
                [T.StructField(name, T.DoubleType()) for name in METRIC_NAMES]
                + [T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType())))]
            ),
        ),
    ]
)

REPUTATION = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("abuse_score", T.IntegerType()),
        T.StructField("vt_positives", T.IntegerType()),
        T.StructField("shodan_ports", T.ArrayType(T.IntegerType())),
        T.StructField("isp", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("enrichment_source", T.StringType()),
    ]
)
