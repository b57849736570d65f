"""Trailing-window host profiles and the flow feature tables.

Nearly everything a host profile needs is additive over flows, because all
initiator-side packets of a flow share one destination address, port and protocol.
So profiles come from the (small) flow table: value counts are summed per
(host, dimension, value) and only then per host, which spreads a heavy scanner over
its values. Only the variance of inter-arrival times needs packets again; those are
joined to the flows inside the window and cut into time buckets per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.functions.exprs import entropy_bits, spread
from scoutlake.functions.gaps import sorted_gap_moments
from scoutlake.operators.flows import KEY, with_flow_key
from scoutlake.params import DEFAULT, Params
from scoutlake.schemas import FEATURES_20, FEATURES_34, HOST_FEATURES, HOST_FEATURES_EXTRA
from scoutlake.session import small_table

HOST_KEY = ["capture", "window_s", "src_ip"]


def flows_in_windows(
    flows: DataFrame, windows_s: list[int], as_of: float | None = None
) -> DataFrame:
    """One row per flow and window whose trailing span still covers the flow's end.

    ``as_of`` defaults to each capture's latest flow end. A flow meets at most
    ``len(windows_s)`` windows, so this is a bounded expansion and no join.
    """
    if as_of is None:
        latest = flows.groupBy("capture").agg(F.max("end_s").alias("as_of"))
        flows = flows.join(small_table(latest), "capture")
    else:
        flows = flows.withColumn("as_of", F.lit(float(as_of)))
    # Whole seconds: an integer key keeps joins and windows on one partitioning.
    sizes = F.array(*[F.lit(int(w)) for w in windows_s])
    age = F.col("as_of") - F.col("end_s")
    covering = F.filter(sizes, lambda w: (F.col("as_of") <= 0.0) | ~(age > w))
    return flows.withColumn("window_s", F.explode(covering)).drop("as_of")


def _contributions(windowed: DataFrame) -> DataFrame:
    """Initiator-side packets of every flow as (dst, port, proto, counts).

    A flow between two ports of one address has initiator-side packets both ways.
    """


    def side(prefix: str, port: str, flows: int) -> str:
        counts = ["packets", "bytes", "sq", "syn_any", "first", "last"]
        fields = ", ".join(f"'{c}', {prefix}_{c}" for c in counts)
        return f"named_struct('dst', dst_ip, 'port', {port}, 'flows', {flows}, {fields})"

    loops = "src_ip = dst_ip AND bwd_packets > 0"
    back = f"CASE WHEN {loops} THEN {side('bwd', 'src_port', 0)} END"
    return windowed.selectExpr(
        *HOST_KEY,
        "proto",
        "syn > 0 AND ack = 0 AS failed",
        f"explode(array_compact(array({side('fwd', 'dst_port', 1)}, {back}))) AS s",
    ).selectExpr(*HOST_KEY, "proto", "failed", "s.*")


def value_counts(windowed: DataFrame) -> DataFrame:
    """Packets per (host, dimension, value); dimensions: ip, port (TCP/UDP), proto."""
    dims = """array_compact(array(
        named_struct('dim', 'ip', 'value', dst),
        CASE WHEN proto IN (6, 17) THEN named_struct('dim', 'port', 'value', CAST(port AS STRING)) END,
        named_struct('dim', 'proto', 'value', CAST(proto AS STRING))))"""
    part = _contributions(windowed).selectExpr(*HOST_KEY, "packets", f"explode({dims}) AS d")
    return part.groupBy(*HOST_KEY, "d.dim", "d.value").agg(F.sum("packets").alias("c"))


def dimension_entropy(counts: DataFrame) -> DataFrame:
    c = F.col("c").cast("double")
    aggs = []
    for dim in ["ip", "port", "proto"]:
        mine = F.col("dim") == dim
        aggs += [
            F.count_if(mine).alias(f"{dim}_distinct"),
            entropy_bits(
                F.sum(F.when(mine, F.col("c"))), F.sum(F.when(mine, c * F.log2(c)))
            ).alias(f"{dim}_entropy"),
        ]
    return counts.groupBy(*HOST_KEY).agg(*aggs)


def host_totals(windowed: DataFrame) -> DataFrame:
    sums = ["packets", "bytes", "sq", "syn_any", "flows"]
    texts = [
        *[f"sum({c}) AS {c}" for c in sums],
        "sum(CASE WHEN port = 53 THEN packets ELSE 0 END) AS dns",
        "sum(CASE WHEN proto = 1 THEN packets ELSE 0 END) AS icmp",
        "min(first) AS first",
        "max(last) AS last",
        "sum(CASE WHEN failed THEN flows ELSE 0 END) AS failed",
    ]
    return _contributions(windowed).groupBy(*HOST_KEY).agg(*[F.expr(t) for t in texts])


def initiator_times(
    packets: DataFrame, windowed: DataFrame, segmented: bool = False
) -> DataFrame:
    """(host, ts_s) of initiator-side packets of the flows inside each window."""
    want = windowed.select(
        *KEY, "window_s", F.col("src_ip").alias("host"), "start_s", "end_s"
    )
    joined = with_flow_key(packets).select(*KEY, "src_ip", "ts_s").join(want, KEY)
    if segmented:
        joined = joined.filter(F.col("ts_s").between(F.col("start_s"), F.col("end_s")))
    return joined.filter(F.col("src_ip") == F.col("host")).select(
        "capture", "window_s", "src_ip", "ts_s"
    )


def host_profiles(
    packets: DataFrame,
    flows: DataFrame,
    windows_s: list[int] | None = None,
    rate_floor: float = DEFAULT.rate_floor_20,
    as_of: float | None = None,
    segmented: bool = False,
    bucket_s: float = 1.0,
) -> DataFrame:
    """All host features per (capture, window, initiating host)."""
    windowed = flows_in_windows(flows, windows_s or [DEFAULT.host_window_s], as_of)
    gaps = sorted_gap_moments(
        initiator_times(packets, windowed, segmented), HOST_KEY, "ts_s", bucket_s
    )
    host = (
        host_totals(windowed)
        .join(dimension_entropy(value_counts(windowed)), HOST_KEY)
        .join(gaps, HOST_KEY)
        .withColumn("host_packet_size_var", spread("packets", "bytes", "sq"))
        .selectExpr(
            "*",
            "last - first AS span",
            "CASE WHEN packets > 1 THEN (last - first) / (packets - 1) ELSE 0.0D END AS mean",
            "sqrt(gap_var) AS dev",
        )
    )
    return host.selectExpr(
        *HOST_KEY,
        "port_entropy AS host_port_entropy",
        "ip_entropy AS host_dst_entropy",
        "CAST(ip_distinct AS DOUBLE) AS host_dst_diversity",
        "syn_any / packets AS host_syn_ratio",
        "failed / flows AS host_failed_flow_ratio",
        f"packets / greatest({rate_floor}D, span) AS host_packet_rate",
        "mean AS host_interval_mean",
        "gap_var AS host_interval_var",
        "host_packet_size_var",
        "CAST(port_distinct AS DOUBLE) AS host_port_diversity",
        "proto_entropy AS host_proto_entropy",
        "dns / packets AS host_dns_ratio",
        "icmp / packets AS host_icmp_ratio",
        "(dev - mean) / greatest(0.0001D, dev + mean) AS host_burstiness",
        "span AS host_session_duration",
        "packets AS host_packets",
        "flows AS host_flows",
    )


def flow_feature_columns(duration_floor: float = 0.0001) -> dict[str, Column]:
    busy = f"greatest({duration_floor}D, duration_s)"
    texts = {
        "flow_duration": "duration_s",
        "flow_packet_count": "packets",
        "flow_bytes": "bytes",
        **{f"flow_{f}_ratio": f"{f} / packets" for f in ["syn", "ack", "rst", "fin"]},
        "flow_size_mean": "size_mean",
        "flow_size_var": "size_var",
        "flow_interval_mean": "interval_mean",
        "flow_interval_var": "interval_var",
        "flow_packets_per_sec": f"packets / {busy}",
        "flow_bytes_per_sec": f"bytes / {busy}",
        "flow_syn_ack_ratio": "syn / greatest(1, ack)",
        **{f"flow_tcp_{f}": f for f in ["syn", "ack", "rst", "fin", "psh"]},
    }
    return {name: F.expr(f"CAST({t} AS DOUBLE)") for name, t in texts.items()}


FLOW_IDS = ["capture", "segment", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto"]
FLOW_FACTS = [
    "first_id", "packets", "syn", "ack", "rst", "fin", "no_flags", "start_s", "end_s", "duration_s",
]


def attach_hosts(flows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Flow features plus the profile of the initiator; hosts outside the window get
    defaults (diversity 1, the rest 0)."""
    names = HOST_FEATURES + HOST_FEATURES_EXTRA
    features = flow_feature_columns()
    featured = flows.select(*FLOW_IDS, *FLOW_FACTS, *[c.alias(k) for k, c in features.items()])
    joined = featured.join(
        hosts.select("capture", "src_ip", *names), ["capture", "src_ip"], "left"
    )

    def filled(name: str) -> str:
        default = "1.0D" if name == "host_dst_diversity" else "0.0D"
        return f"coalesce({name}, {default}) AS {name}"

    return joined.selectExpr(*FLOW_IDS, *FLOW_FACTS, *features, *[filled(n) for n in names])


def feature_table(
    packets: DataFrame, flows: DataFrame, wide: bool = False, params: Params = DEFAULT, segmented: bool = False
) -> DataFrame:
    """The 20-column (or 34-column) feature table with flow identity and facts. With
    ``segmented`` flows are cut by a timeout, and only packets inside of them count."""
    floor = params.rate_floor_34 if wide else params.rate_floor_20
    hosts = host_profiles(packets, flows, [params.host_window_s], floor, segmented=segmented)
    names = FEATURES_34 if wide else FEATURES_20
    return attach_hosts(flows, hosts).select(*FLOW_IDS, *FLOW_FACTS, *names)
