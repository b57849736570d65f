"""Capture files to packet tables.

A folder of pcap/pcapng files is read in byte ranges, so a file of any size is spread over
many tasks (see ``ranges``). Python only finds the record boundaries; every header field
is decoded by column expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutlake.functions.exprs import utc_text
from scoutlake.params import DEFAULT
from scoutlake.sources.ranges import RANGE_BYTES, open_bytes, planned_ranges, records_in, spread

FRAMES = "capture string, pkt_id bigint, ts_s double, linktype int, frame binary"
BATCH = 4096
BATCH_BYTES = 8 << 20

# Link types.
ETHERNET, NULL_LOOPBACK, RAW_IP, LINUX_SLL = 1, 0, (101, 228), 113


def file_key(root: str) -> Column:
    """Path of a file below ``root``, so that equal names in different folders stay apart;
    the name where ``root`` is the file itself, the whole path where it is a pattern."""
    plain = re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", root).rstrip("/")
    at = F.locate(plain + "/", F.col("path"))
    below = F.substr(F.col("path"), at + len(plain) + 1)
    name = F.element_at(F.split("path", "/"), -1)
    return F.when(at > 0, below).when(F.endswith(F.col("path"), F.lit(plain)), name).otherwise(F.col("path"))


def read_frames(
    spark: SparkSession, path: str, glob: str = "*.pcap*", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(capture, pkt_id, ts_s, linktype, frame) of all capture files under ``path``."""
    plan = planned_ranges(capture_files(spark, path, glob, "path"), range_bytes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["capture", "pkt_id", "ts_s", "linktype", "frame"]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows, held = [], 0
                for i, (ts, linktype, frame) in enumerate(records_in(r.path, r.length, r.start, r.end, r.state)):
                    if linktype is not None:
                        rows.append((r.capture, r.first + i, ts, linktype, frame))
                        held += len(frame)
                    if len(rows) == BATCH or held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spread(plan.where("n > 0")).mapInPandas(cut, FRAMES)


def _number(at: Column, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at 0-based offset ``at``."""
    part = F.substring(F.col("frame"), at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def _address(at: Column) -> Column:
    return F.concat_ws(".", *[_number(at + i, 1).cast("string") for i in range(4)])


# TCP flag bits and letters in the order they are written.
FLAG_BITS = [(1, "F"), (2, "S"), (4, "R"), (8, "P"), (16, "A"), (32, "U"), (64, "E"), (128, "C")]


def decode_frames(frames: DataFrame) -> DataFrame:
    """PACKET rows of the IPv4 frames; all others are dropped."""
    kind = F.col("linktype")
    tagged = _number(F.lit(12), 2) == 0x8100
    ip_at = (
        F.when((kind == ETHERNET) & tagged, 18)
        .when(kind == ETHERNET, 14)
        .when(kind.isin(*RAW_IP), 0)
        .when(kind == LINUX_SLL, 16)
        .when(kind == NULL_LOOPBACK, 4)
    )
    ether = F.when((kind == ETHERNET) & tagged, _number(F.lit(16), 2)).when(
        kind == ETHERNET, _number(F.lit(12), 2)
    ).when(kind == LINUX_SLL, _number(F.lit(14), 2))
    is_ip = F.coalesce(ether == 0x0800, F.lit(True))
    o = F.col("o")
    located = frames.withColumn("o", ip_at).filter(F.col("o").isNotNull() & is_ip)
    first = _number(o, 1)
    headed = located.withColumns(
        {"version": F.shiftright(first, 4), "ihl": first.bitwiseAND(15) * 4, "total": _number(o + 2, 2)}
    ).filter((F.col("version") == 4) & (F.length("frame") >= o + 20))
    caught = F.length("frame") - o
    size = F.when(F.col("total") > 0, F.least(F.col("total"), caught)).otherwise(caught)
    body = o + F.col("ihl").cast("int")
    whole = _number(o + 6, 2).bitwiseAND(0x1FFF) == 0
    fields = headed.select(
        "capture",
        "pkt_id",
        "ts_s",
        _address(o + 12).alias("src_ip"),
        _address(o + 16).alias("dst_ip"),
        _number(o + 9, 1).cast("int").alias("proto"),
        F.greatest(F.lit(0), size - F.col("ihl")).cast("int").alias("payload_len"),
        F.when(whole, _number(body, 2)).alias("sport"),
        F.when(whole, _number(body + 2, 2)).alias("dport"),
        F.when(whole, _number(body + 13, 1)).alias("bits"),
    )
    ported = F.col("proto").isin(6, 17)
    letters = F.concat(*[F.when(F.col("bits").bitwiseAND(b) > 0, letter).otherwise("") for b, letter in FLAG_BITS])
    return fields.select(
        "capture",
        "pkt_id",
        "ts_s",
        "src_ip",
        "dst_ip",
        F.coalesce(F.when(ported, F.col("sport")), F.lit(0)).cast("int").alias("src_port"),
        F.coalesce(F.when(ported, F.col("dport")), F.lit(0)).cast("int").alias("dst_port"),
        "proto",
        "payload_len",
        F.coalesce(F.when(F.col("proto") == 6, letters), F.lit("")).alias("flags"),
    )


def read_captures(
    spark: SparkSession, path: str, glob: str = "*.pcap*", max_packets: int | None = None
) -> DataFrame:
    """Packets of all captures; ``max_packets`` keeps the first so many of each file."""
    packets = decode_frames(read_frames(spark, path, glob))
    if max_packets is None:
        return packets
    # Numbered in blocks, so no task orders a whole capture.
    keys = ["capture", "_block"]
    blocked = packets.withColumn("_block", F.expr(f"pkt_id div {DEFAULT.chunk_rows}"))
    before = Window.partitionBy("capture").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy(*keys).agg(F.count("*").alias("_size"))
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    ranked = blocked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("pkt_id")))
    wanted = offsets.where(F.col("_offset") < max_packets)
    return ranked.join(wanted, keys).where(F.col("_offset") + F.col("_n") <= max_packets).select(packets.columns)


def capture_metadata(packets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per capture: packets, duration, distinct addresses, protocol counts, UTC span.

    ``files`` (capture, length) adds the size and captures without any packet.
    """
    span = packets.groupBy("capture").agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.min_by("ts_s", "pkt_id").alias("_start"),
        F.max_by("ts_s", "pkt_id").alias("_end"),
        F.count_if(F.col("proto") == 6).alias("tcp"),
        F.count_if(F.col("proto") == 17).alias("udp"),
        F.count_if(~F.col("proto").isin(6, 17)).alias("other"),
    )
    ips = (
        packets.select("capture", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
        .groupBy("capture")
        .agg(F.countDistinct("ip").alias("unique_ips_count"))
    )
    both = span.join(ips, "capture")
    if files is not None:
        sized = files.select("capture", (F.col("length") / (1024.0 * 1024.0)).alias("file_size_mb"))
        both = sized.join(both, "capture", "left")
    fmt = "yyyy-MM-dd HH:mm:ss 'UTC'"
    counts = ["total_packets", "unique_ips_count", "tcp", "udp", "other"]
    return both.select(
        "capture",
        *([F.col("file_size_mb")] if files is not None else []),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce(F.col("_end") - F.col("_start"), F.lit(0.0)).alias("duration_seconds"),
        F.coalesce(utc_text("_start", fmt), F.lit("N/A")).alias("start_time_utc"),
        F.coalesce(utc_text("_end", fmt), F.lit("N/A")).alias("end_time_utc"),
    )


def capture_files(spark: SparkSession, path: str, glob: str = "*.pcap*", *more: str) -> DataFrame:
    """(capture, length, *more) without reading the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(file_key(path).alias("capture"), "length", *more)


def _of_each_file(files: DataFrame, found: str, read: Callable) -> DataFrame:
    """``read`` (open file to a text) of each of ``files`` (file, length, path), as ``found``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                with open_bytes(path) as file:
                    out.append(read(file))
            yield pd.DataFrame({"file": pdf["file"], "length": pdf["length"], found: out})

    return files.mapInPandas(run, f"file string, length long, {found} string")


def _sha256(file) -> str:
    digest = hashlib.sha256()
    while part := file.read(1 << 20):
        digest.update(part)
    return digest.hexdigest()


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, length, sha256); files of any size pass through a small window."""
    files = capture_files(spark, path, glob, "path").withColumnRenamed("capture", "file")
    return _of_each_file(files, "sha256", _sha256)


def leading_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """First 20 bytes as text and whether the file is really a saved web page; reads no more."""
    files = capture_files(spark, path, glob, "path").withColumnRenamed("capture", "file")
    heads = _of_each_file(files, "first_20_bytes", lambda file: file.read(20).decode("ISO-8859-1"))
    page = F.lower(F.ltrim("first_20_bytes")).rlike("^<(!doctype|html)")
    return heads.select("file", "first_20_bytes", F.when(page, "CORRUPTED_HTML_DOWNLOAD").otherwise("OK").alias("status"))
