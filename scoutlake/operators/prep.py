"""Projections and predicates: one schema for public data sets, filters, name sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.functions.exprs import finite_or_zero, safe_div, to_number, total
from scoutlake.operators.splits import per_class_sample, row_hash
from scoutlake.schemas import FEATURES_20, FLOW_FEATURES, HOST_FEATURES

IDENTIFIERS = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "timestamp", "pcap_filename"]


def canonical(df: DataFrame, *extra: str) -> DataFrame:
    names = extra or ("label", "dataset_source", "attack_type")
    return df.select(*FEATURES_20, *names)


def drop_identifiers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.drop(*(names or IDENTIFIERS))


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def cleaned(df: DataFrame, names: list[str]) -> DataFrame:
    """Null, NaN and infinity become 0 in ``names``."""
    return df.withColumns({n: finite_or_zero(n) for n in names})


def with_missing(
    df: DataFrame, source: str = "unknown", attack: Column | str = "unknown"
) -> DataFrame:
    """Absent features as 0, absent source and attack type as given."""
    attack = F.lit(attack) if isinstance(attack, str) else attack
    wanted = {n: F.lit(0.0) for n in FEATURES_20}
    wanted |= {"dataset_source": F.lit(source), "attack_type": attack}
    return df.withColumns({n: c for n, c in wanted.items() if n not in df.columns})


def _mapped(df: DataFrame, given: dict[str, Column], facts: dict[str, Column]) -> DataFrame:
    """Canonical table: given features, 0 for what a per-flow data set cannot know."""
    features = {n: finite_or_zero(given.get(n, F.lit(0.0)).cast("double")) for n in FEATURES_20}
    return df.select(
        *[c.alias(n) for n, c in features.items()], *[c.alias(n) for n, c in facts.items()]
    )


def map_cic(df: DataFrame, source: str = "cic_ids_2017", normalise_units: bool = False) -> DataFrame:
    """CIC-IDS-2017 flows. Inter-arrival stays in microseconds unless ``normalise_units``."""
    df = trimmed_names(df)
    scale = 1e6 if normalise_units else 1.0
    packets = to_number("Total Fwd Packets") + to_number("Total Backward Packets")
    size = to_number("Total Length of Fwd Packets") + to_number("Total Length of Bwd Packets")
    iat_std = to_number("Flow IAT Std") / scale
    label = F.trim("Label")
    given = {
        "flow_duration": to_number("Flow Duration") / 1e6,
        "flow_packet_count": packets,
        "flow_bytes": size,
        **{
            f"flow_{flag.lower()}_ratio": safe_div(to_number(f"{flag} Flag Count"), packets)
            for flag in ["SYN", "ACK", "RST", "FIN"]
        },
        "flow_size_mean": to_number("Packet Length Mean"),
        "flow_size_var": to_number("Packet Length Variance"),
        "flow_interval_mean": to_number("Flow IAT Mean") / scale,
        "flow_interval_var": iat_std * iat_std,
    }
    facts = {
        "label": (label != "BENIGN").cast("int"),
        "attack_type": label,
        "dataset_source": F.lit(source),
    }
    return _mapped(df, given, facts)


# Connection states read as SYN-only and as reset.
SYN_STATES = ["SYN", "S0", "S1"]
RST_STATES = ["RST", "RSTO", "RSTR", "RSTRH"]


def unsw_subset(
    df: DataFrame, row_id: str, order: Column | None = None, bucket: Column | None = None
) -> DataFrame:
    """All reconnaissance rows and a fixed random sample of twice as many benign ones."""
    kind = same_text(F.col("attack_cat"), "reconnaissance")
    benign = to_number("label") == 0
    tagged = df.withColumn("_class", F.when(kind, "recon").when(benign, "benign")).filter(
        F.col("_class").isNotNull()
    )
    recon = tagged.filter("_class = 'recon'")
    wanted = 2 * recon.count()
    order = row_hash(row_id) if order is None else order
    sample = per_class_sample(tagged.filter("_class = 'benign'"), "_class", wanted, row_id, order, bucket)
    return recon.unionByName(sample).drop("_class")


def map_unsw(df: DataFrame, source: str = "unsw_nb15", normalise_units: bool = False) -> DataFrame:
    """UNSW-NB15 flows (49 text columns). Inter-packet times stay in milliseconds unless
    ``normalise_units``."""
    packets = to_number("spkts") + to_number("dpkts")
    size = to_number("sbytes") + to_number("dbytes")
    state = F.coalesce(F.upper(F.trim("state")), F.lit(""))
    scale = 1e3 if normalise_units else 1.0
    given = {
        "flow_duration": to_number("dur"),
        "flow_packet_count": packets,
        "flow_bytes": size,
        "flow_syn_ratio": state.isin(SYN_STATES).cast("double"),
        "flow_rst_ratio": state.isin(RST_STATES).cast("double"),
        "flow_size_mean": safe_div(size, packets),
        "flow_interval_mean": (to_number("sintpkt") + to_number("dintpkt")) / 2.0 / scale,
    }
    facts = {
        "label": to_number("label").cast("int"),
        "attack_type": F.coalesce(F.trim("attack_cat"), F.lit("benign")),
        "dataset_source": F.lit(source),
    }
    return _mapped(df, given, facts)


def map_ton_iot(df: DataFrame, source: str = "nf_ton_iot_v2") -> DataFrame:
    """NF-ToN-IoT-v2 NetFlow rows; scanning against benign."""
    seconds = to_number("FLOW_DURATION_MILLISECONDS") / 1000.0
    packets = to_number("IN_PKTS") + to_number("OUT_PKTS")
    size = to_number("IN_BYTES") + to_number("OUT_BYTES")
    given = {
        "flow_duration": seconds,
        "flow_packet_count": packets,
        "flow_bytes": size,
        "flow_size_mean": safe_div(size, packets),
        "flow_interval_mean": safe_div(seconds, packets),
    }
    facts = {
        "label": (F.col("Attack") == "scanning").cast("int"),
        "attack_type": F.col("Attack"),
        "dataset_source": F.lit(source),
    }
    return _mapped(df.filter(F.col("Attack").isin("scanning", "Benign")), given, facts)


# How each canonical flow feature is obtained per public data set; host
# features are unavailable in all of them.
MAPPING_KINDS = {
    "cic": {
        "direct": ["flow_duration", "flow_size_mean", "flow_size_var", "flow_interval_mean"],
        "computed": [
            "flow_packet_count", "flow_bytes", "flow_syn_ratio", "flow_ack_ratio",
            "flow_rst_ratio", "flow_fin_ratio",
        ],
        "approximated": ["flow_interval_var"],
    },
    "unsw": {
        "direct": ["flow_duration"],
        "computed": ["flow_packet_count", "flow_bytes", "flow_size_mean"],
        "approximated": ["flow_syn_ratio", "flow_rst_ratio", "flow_interval_mean"],
    },
}


def mapping_table(spark: SparkSession) -> DataFrame:
    """(dataset, feature, kind) for every canonical feature."""
    rows = []
    for dataset, kinds in MAPPING_KINDS.items():
        by_feature = {f: kind for kind, fs in kinds.items() for f in fs}
        rows += [(dataset, f, by_feature.get(f, "unavailable")) for f in FEATURES_20]
    return spark.createDataFrame(rows, "dataset string, feature string, kind string")


def mapping_coverage(mappings: DataFrame) -> DataFrame:
    kinds = ["direct", "computed", "approximated", "unavailable"]
    return mappings.groupBy("dataset").pivot("kind", kinds).count().na.fill(0)


def same_text(c: Column, word: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == F.lit(word), F.lit(False))


def search_packets(packets: DataFrame, protocol: str = "all", text: str = "") -> DataFrame:
    """Protocol filter and case-folded text search over addresses, ports and flags."""
    numbers = {"tcp": 6, "udp": 17}
    if protocol.lower() in numbers:
        packets = packets.filter(F.col("proto") == numbers[protocol.lower()])
    needle = text.strip().lower()
    if not needle:
        return packets
    fields = ["src_ip", "dst_ip", "src_port", "dst_port", "flags"]
    hits = [F.lower(F.col(c).cast("string")).contains(needle) for c in fields]
    return packets.filter(F.array_contains(F.array(*hits), True))


# Severities each notion of "anomaly" accepts.
ANOMALY_LEVELS = {
    "report": ["CRITICAL", "HIGH", "MEDIUM"],
    "alert": ["CRITICAL", "HIGH", "MEDIUM", "LOW"],
    "radar": ["CRITICAL", "HIGH", "MEDIUM"],
}


def anomalous(kind: str = "report", prediction: str = "prediction") -> Column:
    """'report' and 'alert' also accept any positive prediction; 'radar' does not."""
    severe = F.col("severity").isin(ANOMALY_LEVELS[kind])
    return severe if kind == "radar" else severe | (F.col(prediction) == 1)


# Name sets of the ablation study: configuration -> which feature names stay.
ABLATIONS: dict[str, Callable[[str], bool]] = {
    "Full proposed model": lambda n: True,
    "Without temporal features": lambda n: "_interval_" not in n,
    "Without entropy features": lambda n: "entropy" not in n,
    "Without host-level features": lambda n: not n.startswith("host_"),
    "Without TCP-flag features": lambda n: not n.endswith(
        ("syn_ratio", "ack_ratio", "rst_ratio", "fin_ratio")
    ),
    "Without failed-flow ratio": lambda n: "failed_flow" not in n,
}


def ablation_features(configuration: str, names: list[str] | None = None) -> list[str]:
    return [n for n in (names or FEATURES_20) if ABLATIONS[configuration](n)]


def flow_only_features() -> list[str]:
    return [n for n in FEATURES_20 if n in FLOW_FEATURES and n not in HOST_FEATURES]


def feature_total(names: list[str]) -> Column:
    """Sum of the named features, for quick projections in reports."""
    return total([F.col(n) for n in names])
