"""Packet view over an ``events`` table.

A deterministic projection gives every event the role of one packet (scanners, FIN
and NULL probers, ICMP, DNS, two-way TCP); one hour of event time is one second.
It lets the operators run over event tables without capture files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def packets_from_events(events: DataFrame) -> DataFrame:
    """``events`` needs a ``capture`` column next to its own columns."""
    role = (F.col("user_id") % 10).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    base = events.select(
        "capture",
        F.col("event_id").alias("pkt_id"),
        "user_id",
        "event_type",
        "value",
        role.alias("u"),
        k.alias("k"),
        (micros / F.lit(3600000000.0)).alias("ts_s"),
    )
    kind = F.col("event_type")
    u = F.col("u")
    flags = (
        F.when(u.isin(2, 8, 9), "")
        .when(u == 0, "S")
        .when(u == 1, "F")
        .when(kind == "signup", "S")
        .when(kind == "view", "SA")
        .when(kind == "click", "PA")
        .when(kind == "purchase", "FA")
        .otherwise("R")
    )
    host = F.concat(
        F.lit("10.0."), F.expr("user_id div 250"), F.lit("."), F.col("user_id") % 250
    )
    near_port = F.when(u == 8, 0).otherwise((40000 + F.col("user_id") % 20000).cast("int"))
    far_port = (
        F.when(u == 0, 20 + F.col("k")).when(u == 8, 0).when(u == 9, 53).otherwise(20 + F.col("k") % 10)
    )
    sided = base.select(
        "capture",
        "pkt_id",
        "ts_s",
        host.alias("h"),
        F.concat(F.lit("192.168.1."), F.col("k") % 5).alias("d"),
        near_port.alias("hp"),
        far_port.cast("int").alias("dp"),
        F.when(u == 9, 17).when(u == 8, 1).otherwise(6).alias("proto"),
        (20 + F.floor("value")).cast("int").alias("payload_len"),
        flags.alias("flags"),
        ((F.col("pkt_id") % 3 == 0) & ~u.isin(0, 1, 2)).alias("back"),
    )

    def either(if_back: str, otherwise: str, missing: str | int):
        # Never null, so joins on these columns add no null tests that would inline
        # this whole projection into a filter above the scan.
        side = F.when(F.col("back"), F.col(if_back)).otherwise(F.col(otherwise))
        return F.coalesce(side, F.lit(missing))

    return sided.select(
        "capture",
        "pkt_id",
        "ts_s",
        either("d", "h", "").alias("src_ip"),
        either("h", "d", "").alias("dst_ip"),
        either("dp", "hp", 0).alias("src_port"),
        either("hp", "dp", 0).alias("dst_port"),
        "proto",
        "payload_len",
        "flags",
    )


def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return packets_from_events(events.withColumn("capture", F.col("_metadata.file_name")))
