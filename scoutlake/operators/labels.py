"""Labels for flow feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.session import checked_broadcast


def heuristic_rule() -> Column:
    """Reconnaissance by any of three rules: port scan, subnet sweep, half-open probe."""
    port_scan = (
        (F.col("host_port_entropy") > 2.0)
        & (F.col("host_failed_flow_ratio") > 0.7)
        & (F.col("flow_syn_ratio") > 0.5)
    )
    sweep = (
        (F.col("host_dst_diversity") > 4)
        & (F.col("host_dst_entropy") > 1.5)
        & (F.col("host_syn_ratio") > 0.7)
    )
    half_open = (
        (F.col("flow_packet_count") <= 2)
        & (F.col("flow_syn_ratio") == 1.0)
        & (F.col("flow_ack_ratio") == 0.0)
        & (F.col("host_port_entropy") > 1.5)
    )
    return port_scan | sweep | half_open


def label_by_rules(features: DataFrame) -> DataFrame:
    return features.withColumn("label", heuristic_rule().cast("int"))


def label_by_scanners(features: DataFrame, scanners: DataFrame) -> DataFrame:
    """1 for flows begun by a listed address (column ``src_ip``), else 0."""
    listed = scanners.select("src_ip").distinct().withColumn("_listed", F.lit(1))
    return (
        features.join(checked_broadcast(listed), "src_ip", "left")
        .withColumn("label", F.coalesce("_listed", F.lit(0)))
        .drop("_listed")
    )


def label_flows(features: DataFrame, scanners: DataFrame | None = None) -> DataFrame:
    """Listed scanners or the rules; either makes a flow positive."""
    if scanners is None:
        return label_by_rules(features)
    listed = label_by_scanners(features, scanners)
    return listed.withColumn("label", F.greatest("label", heuristic_rule().cast("int")))


def label_from_log(table: DataFrame, log: DataFrame) -> DataFrame:
    """Label and attack type of the capture file, from the lab log; of several entries for a
    file, the one with the greatest label, then the greatest attack type."""
    entry = F.max(F.struct("label", "attack_type")).alias("entry")
    lab = log.groupBy("pcap_filename").agg(entry).select("pcap_filename", "entry.*")
    return table.join(checked_broadcast(lab), "pcap_filename", "left").withColumn(
        "attack_type", F.coalesce("attack_type", F.lit("unknown"))
    )


def attack_from_filename(c: str = "pcap_filename") -> Column:
    return F.replace(F.col(c), F.lit(".pcap"), F.lit(""))
