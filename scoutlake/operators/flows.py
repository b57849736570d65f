"""Packets to bidirectional flows.

Flow assembly is one packet-level shuffle. Packets of a flow are cut into arrival
chunks (``pkt_id div chunk_rows``), so even a flow holding a third of the traffic is
spread over many tasks: a chunk of one flow never has more than ``chunk_rows`` rows,
because ``pkt_id`` is unique within a capture. Chunk summaries are merged per flow in
a second, much smaller shuffle. Direction needs no second look at the packets: both
endpoints are counted separately and the initiator picks which one is "forward".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions.exprs import spread
from scoutlake.functions.gaps import merged_gap_stats
from scoutlake.params import DEFAULT

KEY = ["capture", "ip_lo", "ip_hi", "port_lo", "port_hi", "proto"]

# TCP flag letters counted per flow.
FLAG_LETTERS = {"syn": "S", "ack": "A", "rst": "R", "fin": "F", "psh": "P"}


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Direction-free key: the endpoint that sorts first (as text, then port) is 'lo'."""
    keyed = packets.selectExpr(
        "*", "src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS from_lo"
    )
    return keyed.selectExpr(
        "*",
        "CASE WHEN from_lo THEN src_ip ELSE dst_ip END AS ip_lo",
        "CASE WHEN from_lo THEN dst_ip ELSE src_ip END AS ip_hi",
        "CASE WHEN from_lo THEN src_port ELSE dst_port END AS port_lo",
        "CASE WHEN from_lo THEN dst_port ELSE src_port END AS port_hi",
    )


# What is counted for either endpoint of a flow, and how the counts merge.
SIDE_MERGE = {
    "packets": "sum", "bytes": "sum", "sq": "sum", "syn_any": "sum", "first": "min", "last": "max"
}


def _side(side: str, mine: str) -> list[str]:
    size = "CAST(payload_len AS BIGINT)"
    return [
        f"count_if({mine}) AS {side}_packets",
        f"sum(CASE WHEN {mine} THEN {size} ELSE 0 END) AS {side}_bytes",
        f"sum(CASE WHEN {mine} THEN {size} * {size} ELSE 0 END) AS {side}_sq",
        f"count_if({mine} AND contains(upper(flags), 'S')) AS {side}_syn_any",
        f"min(CASE WHEN {mine} THEN ts_s END) AS {side}_first",
        f"max(CASE WHEN {mine} THEN ts_s END) AS {side}_last",
    ]


def flow_counters() -> list[Column]:
    """Aggregates over keyed packets; all of them merge, in batch and in streams."""
    texts = [
        "min(pkt_id) AS first_id",
        "min_by(CAST(from_lo AS INT), pkt_id) AS first_lo",
        "min_by(ts_s, pkt_id) AS start_s",
        "max_by(ts_s, pkt_id) AS end_s",
        *_side("lo", "from_lo"),
        *_side("hi", "NOT from_lo"),
        *[
            f"count_if(proto = 6 AND contains(upper(flags), '{letter}')) AS {name}"
            for name, letter in FLAG_LETTERS.items()
        ],
        "count_if(length(flags) > 0) AS flagged",
    ]
    return [F.expr(t) for t in texts]


def merged_counters() -> list[Column]:
    """The same counters merged from parts of a flow."""
    texts = [
        "min(first_id) AS first_id",
        "min_by(first_lo, first_id) AS first_lo",
        "min_by(start_s, first_id) AS start_s",
        "max_by(end_s, first_id) AS end_s",
        *[f"{how}({s}_{c}) AS {s}_{c}" for s in ("lo", "hi") for c, how in SIDE_MERGE.items()],
        *[f"sum({name}) AS {name}" for name in (*FLAG_LETTERS, "flagged")],
    ]
    return [F.expr(t) for t in texts]


def assemble_flows(
    packets: DataFrame,
    timeout_s: float | None = None,
    chunk_rows: int = DEFAULT.chunk_rows,
) -> DataFrame:
    """FLOW table. With ``timeout_s`` a silence longer than it starts a new segment."""
    keyed = with_flow_key(packets).withColumn("chunk", F.expr(f"pkt_id div {int(chunk_rows)}"))
    arrival = Window.partitionBy(*KEY, "chunk").orderBy("pkt_id")
    keyed = keyed.withColumn("gap", F.col("ts_s") - F.lag("ts_s").over(arrival))
    if timeout_s is None:
        keyed = keyed.withColumn("part", F.lit(0).cast("bigint"))
    else:
        late = F.col("gap") > F.lit(float(timeout_s))
        keyed = keyed.withColumn(
            "part", F.sum(F.when(late, 1).otherwise(0)).over(arrival)
        ).withColumn("gap", F.when(~late, F.col("gap")))

    pieces = keyed.groupBy(*KEY, "chunk", "part").agg(
        *flow_counters(),
        F.count("gap").alias("gap_n"),
        F.avg("gap").alias("gap_mean"),
        (F.var_pop("gap") * F.count("gap")).alias("gap_m2"),
    )

    order = Window.partitionBy(*KEY).orderBy("chunk", "part")
    pieces = pieces.withColumn("edge", F.col("start_s") - F.lag("end_s").over(order))
    if timeout_s is None:
        pieces = pieces.withColumn("segment", F.lit(0).cast("bigint"))
    else:
        opens = F.col("edge").isNotNull() & (
            (F.col("part") > 0) | (F.col("edge") > F.lit(float(timeout_s)))
        )
        pieces = (
            pieces.withColumn("opens", opens)
            .withColumn("segment", F.sum(F.col("opens").cast("bigint")).over(order))
            .withColumn("edge", F.when(~F.col("opens"), F.col("edge")))
        )

    gap_mean, gap_var = merged_gap_stats("chunk", "gap_n", "gap_mean", "gap_m2", "edge")
    merged = pieces.groupBy(*KEY, "segment").agg(
        *merged_counters(), gap_mean.alias("interval_mean"), gap_var.alias("interval_var")
    )
    return oriented(merged)


FLOW_ID = "concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '/', proto)"


def oriented(merged: DataFrame) -> DataFrame:
    """Endpoint counts turned into forward and backward, seen from the first packet."""

    def pick(a: str, b: str, name: str) -> str:
        return f"CASE WHEN first_lo = 1 THEN {a} ELSE {b} END AS {name}"

    sides = [
        pick(f"{x}_{c}", f"{y}_{c}", f"{way}_{c}")
        for way, x, y in (("fwd", "lo", "hi"), ("bwd", "hi", "lo"))
        for c in SIDE_MERGE
    ]
    turned = merged.selectExpr(
        "*",
        pick("ip_lo", "ip_hi", "src_ip"),
        pick("ip_hi", "ip_lo", "dst_ip"),
        pick("port_lo", "port_hi", "src_port"),
        pick("port_hi", "port_lo", "dst_port"),
        *sides,
    ).selectExpr(
        "*",
        "fwd_packets + bwd_packets AS packets",
        "fwd_bytes + bwd_bytes AS bytes",
        "fwd_sq + bwd_sq AS _sq",
    )
    intervals = [c for c in ["interval_mean", "interval_var"] if c in merged.columns]
    return turned.withColumn("size_var", spread("packets", "bytes", "_sq")).selectExpr(
        *KEY,
        "segment",
        "first_id",
        f"{FLOW_ID} AS flow_id",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "packets",
        "bytes",
        *[f"{way}_{c}" for way in ("fwd", "bwd") for c in SIDE_MERGE],
        *FLAG_LETTERS,
        "proto = 6 AND flagged = 0 AS no_flags",
        "start_s",
        "end_s",
        "greatest(0.0D, end_s - start_s) AS duration_s",
        "bytes / packets AS size_mean",
        "size_var",
        *intervals,
    )


def active_flows(flows: DataFrame, as_of: float, timeout_s: float) -> DataFrame:
    """Flows still open at ``as_of``: begun by then and last seen within the timeout."""
    return flows.filter(
        (F.col("start_s") <= F.lit(as_of)) & (F.col("end_s") >= F.lit(as_of - timeout_s))
    )


def at_least(flows: DataFrame, min_packets: int) -> DataFrame:
    return flows.filter(F.col("packets") >= F.lit(int(min_packets)))


def start_times(table: DataFrame, flows: DataFrame, keys: list[str]) -> DataFrame:
    """Start of the flow named by ``keys``; rows without one get the capture's first packet."""
    starts = flows.groupBy(*keys).agg(F.min_by("start_s", "first_id").alias("_start"))
    first = flows.groupBy("capture").agg(F.min_by("start_s", "first_id").alias("_first"))
    return (
        table.join(starts, keys, "left")
        .join(first, "capture", "left")
        .withColumn("timestamp", F.coalesce("_start", "_first"))
        .drop("_start", "_first")
    )
