"""Per-host behavioural profiles, baselines, drift.

Time points of a host (baseline ticks, samples) are at least a fixed gap apart, so
tables of them are bounded by the time span. Events reach their time points by
equi-joins on (host, time block), which spreads a heavy host over time; no task ever
holds all events of one host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutlake.functions.chains import latest_node, spaced_chain, with_neighbours
from scoutlake.functions.exprs import compact_array, filled, fixed, total
from scoutlake.operators.flows import KEY, with_flow_key
from scoutlake.params import DEFAULT, Params
from scoutlake.session import checked_broadcast, stage

HOST = ["capture", "src_ip"]
WINDOWS_S = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600}


def profile_events(packets: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Packets as profile events. With ``flows`` a session is the flow and its duration
    the time since the flow began; without, a session is (dst, port, protocol)."""
    facts = [
        "ts_s",
        "pkt_id",
        F.col("payload_len").alias("bytes_len"),
        F.col("proto").cast("string").alias("protocol"),
        "dst_ip",
        "dst_port",
    ]
    if flows is None:
        return packets.select(
            *HOST,
            *facts,
            F.concat_ws("|", "dst_ip", "dst_port", "proto").alias("session_id"),
            F.lit(0.0).alias("session_duration"),
        )
    begun = flows.filter("segment = 0").select(*KEY, F.col("start_s").alias("_start"))
    joined = with_flow_key(packets).join(begun, KEY)
    return joined.select(
        *HOST,
        *facts,
        F.concat_ws("|", *KEY[1:]).alias("session_id"),
        F.greatest(F.lit(0.0), F.col("ts_s") - F.col("_start")).alias("session_duration"),
    )


def window_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Packets, bytes, protocol counts, distinct addresses/ports/sessions and the mean of
    positive session durations. The planner expands the distinct counts, so a heavy key
    is first reduced per value."""
    lasting = F.when(F.col("session_duration") > 0, F.col("session_duration"))
    core = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("bytes_len").alias("bytes_transferred"),
        F.countDistinct("dst_ip").alias("destination_ip_count"),
        F.countDistinct("dst_port").alias("destination_port_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.coalesce(F.avg(lasting), F.lit(0.0)).alias("mean_session_duration"),
    )
    protocols = (
        events.groupBy(*keys, "protocol")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("protocol", "c"))).alias("protocol_usage"))
    )
    return core.join(protocols, keys)


def lifetime_totals(events: DataFrame) -> DataFrame:
    return window_stats(events, HOST).drop("mean_session_duration")


def trailing_stats(events: DataFrame, as_of: float, sizes: dict[str, int] | None = None) -> DataFrame:
    """Stats per host and named window ending at ``as_of``; both bounds belong to it."""
    sizes = sizes or WINDOWS_S
    age = F.lit(float(as_of)) - F.col("ts_s")
    names = F.array(*[F.when(age <= size, F.lit(name)) for name, size in sizes.items()])
    recent = events.filter((age >= 0) & (age <= max(sizes.values())))
    spread = recent.withColumn("window", F.explode(F.array_compact(names)))
    return window_stats(spread, [*HOST, "window"])


def retained_events(events: DataFrame, as_of: float, keep_s: float = DEFAULT.retention_s) -> DataFrame:
    return events.filter(F.col("ts_s") >= F.lit(float(as_of) - keep_s))


NO_PROTOCOLS = "map<string,bigint>"


def stats_at(events: DataFrame, points: DataFrame, window_s: float) -> DataFrame:
    """Stats of ``[at - window_s, at]`` for every point (host columns, ``at``, optional
    ``at_id``: events at that very instant count up to this packet id).

    Points meet events by equi-join on (host, block of ``window_s``); a point looks at
    the two blocks its window touches.
    """
    size = F.lit(float(window_s))
    has_id = "at_id" in points.columns
    if not has_id:
        points = points.withColumn("at_id", F.lit(2**62))
    first, last = F.floor((F.col("at") - size) / size), F.floor(F.col("at") / size)
    wanted = points.select(*HOST, "at", "at_id", F.explode(F.sequence(first, last)).alias("_b"))
    placed = events.withColumn("_b", F.floor(F.col("ts_s") / size))
    inside = (F.col("ts_s") >= F.col("at") - size) & (
        (F.col("ts_s") < F.col("at"))
        | ((F.col("ts_s") == F.col("at")) & (F.col("pkt_id") <= F.col("at_id")))
    )
    met = placed.join(wanted, [*HOST, "_b"]).filter(inside)
    stats = window_stats(met, [*HOST, "at"])
    filled = points.join(stats, [*HOST, "at"], "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in stats.columns if c not in [*HOST, "at", "protocol_usage"]}
    zeros["protocol_usage"] = F.coalesce("protocol_usage", F.create_map().cast(NO_PROTOCOLS))
    filled = filled.withColumns(zeros)
    return filled if has_id else filled.drop("at_id")


def baseline_ticks(events: DataFrame, params: Params = DEFAULT, limit: int = 200_000) -> DataFrame:
    """One row per baseline tick with the stats of the interval it closes.

    The first event of a host sets the clock; a tick is the first event at least
    ``baseline_interval_s`` after the tick before it, looks back over the whole seconds
    elapsed (closed bounds) and counts itself but no later packet of the same instant.
    """
    gap = params.baseline_interval_s
    nodes = with_neighbours(spaced_chain(events, HOST, "ts_s", gap, inclusive=True, limit=limit), HOST)
    placed = latest_node(events, stage(nodes, "ticks"), HOST, "ts_s", gap)
    ahead = (
        placed.filter(F.col("after").isNotNull())
        .withColumns({"tick": F.col("after"), "elapsed": F.col("after") - F.col("node")})
        .filter(F.col("ts_s") >= F.col("tick") - F.floor("elapsed"))
    )
    facts = events.columns
    own = (
        placed.filter((F.col("ts_s") == F.col("node")) & F.col("before").isNotNull())
        .withColumns({"tick": F.col("node"), "elapsed": F.col("node") - F.col("before")})
        .groupBy(*HOST, "tick", "elapsed")
        .agg(F.min_by(F.struct(*[c for c in facts if c not in HOST]), "pkt_id").alias("e"))
        .select(*HOST, "tick", "elapsed", "e.*")
    )
    both = ahead.select(*facts, "tick", "elapsed").unionByName(
        own.withColumn("tick_id", F.col("pkt_id")), allowMissingColumns=True
    )
    ids = both.groupBy(*HOST, "tick").agg(F.max("tick_id").alias("at_id"))
    stats = window_stats(both, [*HOST, "tick", "elapsed"]).join(ids, [*HOST, "tick"])
    return stats.withColumns(
        {
            "packet_rate": F.col("packet_count") / F.col("elapsed"),
            "bytes_sec": F.col("bytes_transferred") / F.col("elapsed"),
        }
    )


# Baseline name -> column of the tick table it averages.
BASELINES = {
    "packet_rate": "packet_rate",
    "bytes_sec": "bytes_sec",
    "destination_diversity": "destination_ip_count",
    "port_diversity": "destination_port_count",
    "session_count": "session_count",
    "session_duration": "mean_session_duration",
}


def baselines(ticks: DataFrame, cap: int = DEFAULT.running_mean_cap) -> DataFrame:
    """Baseline after every tick: running means that turn into slow exponential ones
    after ``cap`` ticks, and the protocol shares, where only protocols seen in a tick
    move before all are scaled back to 1.

    The fold depends on its own result, so it runs in Python, over ticks (at most one
    per interval and host) in host and time order, never over events.
    """
    names = list(BASELINES)
    own = [f.name for f in ticks.schema.fields if f.name in HOST]
    schema = T.StructType(
        [f for f in ticks.schema.fields if f.name in HOST]
        + [T.StructField("tick", T.DoubleType()), T.StructField("samples", T.LongType())]
        + [T.StructField(f"base_{n}", T.DoubleType()) for n in names]
        + [T.StructField("base_protocols", T.MapType(T.StringType(), T.DoubleType()))]
    )
    inputs = [*own, "tick", "protocol_usage", *BASELINES.values()]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, samples = None, 0
        means: list[float] = []
        shares: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for row in pdf[inputs].itertuples(index=False, name=None):
                key, (tick, usage, *seen) = row[: len(own)], row[len(own) :]
                if key != host:
                    host, samples, means, shares = key, 0, [0.0] * len(names), {}
                samples += 1
                alpha = 1.0 / min(samples, cap)
                means = [m + alpha * (x - m) for m, x in zip(means, seen, strict=True)]
                usage = dict(usage)
                whole = sum(usage.values())
                if whole > 0:
                    for p, c in usage.items():
                        old = shares.get(p, 0.0)
                        shares[p] = old + alpha * (c / whole - old)
                    mass = sum(shares.values())
                    if mass > 0:
                        shares = {p: v / mass for p, v in shares.items()}
                rows.append((*key, tick, samples, *means, dict(shares)))
            yield pd.DataFrame(rows, columns=schema.names)

    ordered = ticks.select(*inputs).repartition(*HOST).sortWithinPartitions(*HOST, "tick")
    return ordered.mapInPandas(fold, schema)


def _moved(current: Column, base: Column) -> Column:
    """Relative change, at most 1. From nothing to something counts as 1."""
    appeared = F.when(current > 0, 1.0).otherwise(0.0)
    relative = F.least(F.lit(1.0), F.abs(current - base) / F.nullif(base, F.lit(0.0)))
    return F.when(base == 0, appeared).otherwise(relative)


def share_distance(counts: Column, shares: Column) -> Column:
    """Total variation distance between protocol counts and given shares."""
    whole = F.aggregate(F.map_values(counts), F.lit(0.0), lambda acc, c: acc + c)
    names = F.array_union(F.map_keys(counts), F.map_keys(shares))

    def gap(p: Column) -> Column:
        now = F.coalesce(F.try_element_at(counts, p) / F.nullif(whole, F.lit(0.0)), F.lit(0.0))
        return F.abs(now - F.coalesce(F.try_element_at(shares, p), F.lit(0.0)))

    return F.aggregate(F.transform(names, gap), F.lit(0.0), lambda acc, g: acc + g) / 2.0


# Weights of the drift terms.
DRIFT_WEIGHTS = {"packet_rate": 20.0, "destination": 25.0, "port": 25.0, "protocol": 15.0, "session": 15.0}


def drift_score(params: Params = DEFAULT) -> Column:
    """0..100 from window stats next to baseline columns; 0 until enough ticks."""
    rate = F.col("packet_count") / F.lit(params.drift_window_s)
    terms = {
        "packet_rate": _moved(rate, F.col("base_packet_rate")),
        "destination": _moved(F.col("destination_ip_count"), F.col("base_destination_diversity")),
        "port": _moved(F.col("destination_port_count"), F.col("base_port_diversity")),
        "protocol": F.least(F.lit(1.0), share_distance(F.col("protocol_usage"), F.col("base_protocols"))),
        "session": _moved(F.col("mean_session_duration"), F.col("base_session_duration")),
    }
    raw = total([terms[n] * w for n, w in DRIFT_WEIGHTS.items()])
    ready = F.col("samples") >= params.baseline_min_ticks
    # Rounded so that equal behaviour compares equal whatever the summation order.
    return F.when(ready, F.least(F.lit(100.0), F.round(raw, 9))).otherwise(F.lit(0.0))


def snapshots(
    events: DataFrame, ticks: DataFrame, base: DataFrame, threat: DataFrame | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """One row per tick: rate and diversities of the tick, drift against the baseline as
    just updated, and the threat score known by then (``threat``: host, at, value)."""
    points = ticks.select(
        *HOST, F.col("tick").alias("at"), "at_id", "packet_rate",
        F.col("destination_ip_count").alias("destination_diversity"),
        F.col("destination_port_count").alias("port_diversity"),
    )
    current = stats_at(events, points, params.drift_window_s)
    scored = current.join(base.withColumnRenamed("tick", "at"), [*HOST, "at"]).withColumn(
        "drift_score", drift_score(params)
    )
    if threat is None:
        scored = scored.withColumn("threat_score", F.lit(0.0))
    else:
        scored = as_of_value(scored, threat, "at", "value", "threat_score")
    return scored.select(
        *HOST, F.col("at").alias("timestamp"), "packet_rate", "destination_diversity",
        "port_diversity", "drift_score", "threat_score", "samples",
    )


def as_of_value(points: DataFrame, values: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """Latest ``value`` of the host at or before each point; 0 before the first.

    For tables bounded by time (ticks, samples), where one ordered pass per host is small.
    """
    known = values.groupBy(*HOST, at).agg(F.max(value).alias(name))
    marked = points.withColumn("_point", F.lit(True)).unionByName(known, allowMissingColumns=True)
    order = Window.partitionBy(*HOST).orderBy(F.col(at), F.col("_point").isNotNull())
    filled = marked.withColumn(name, F.last(name, ignorenulls=True).over(order))
    return filled.filter("_point").drop("_point").withColumn(name, F.coalesce(name, F.lit(0.0)))


def latest_baselines(base: DataFrame, as_of: float) -> DataFrame:
    kept = base.filter(F.col("tick") <= F.lit(float(as_of)))
    rest = [c for c in base.columns if c not in HOST]
    return kept.groupBy(*HOST).agg(F.max_by(F.struct(*rest), "tick").alias("b")).select(*HOST, "b.*")


def host_drift(
    events: DataFrame, base: DataFrame, as_of: float, params: Params = DEFAULT
) -> DataFrame:
    """Every host's drift-window stats at ``as_of``, its latest baseline and its drift."""
    hosts = events.filter(F.col("ts_s") <= F.lit(float(as_of))).select(*HOST).distinct()
    current = trailing_stats(events, as_of, {"drift": int(params.drift_window_s)}).drop("window")
    joined = hosts.join(current, HOST, "left").join(latest_baselines(base, as_of), HOST, "left")
    counts = ["packet_count", "bytes_transferred", "destination_ip_count", "destination_port_count", "session_count"]
    zeros = {c: F.coalesce(c, F.lit(0)) for c in [*counts, "samples"]}
    zeros |= {c: F.coalesce(c, F.lit(0.0)) for c in ["mean_session_duration", *[f"base_{n}" for n in BASELINES]]}
    zeros["protocol_usage"] = F.coalesce("protocol_usage", F.create_map().cast(NO_PROTOCOLS))
    zeros["base_protocols"] = F.coalesce("base_protocols", F.create_map().cast("map<string,double>"))
    return joined.withColumns(zeros).withColumn("drift_score", drift_score(params))


# Notes on how a host departs from its baseline.
NOTES = {
    "first": "{name} appeared for the first time (currently {now}).",
    "moved_to": "{name} {verb} from {base} to {now}.",
    "moved_by": "{name} {verb} by {percent}%.",
    "syn": "SYN ratio increased significantly.",
    "deviates": "Host behavior deviates {times}x from its historical baseline.",
}


def drift_notes(params: Params = DEFAULT, syn_ratio: str | None = None) -> Column:
    """Plain-language notes on how a host differs from its baseline."""
    rate = F.col("packet_count") / F.lit(params.drift_window_s)
    # (name, current, baseline, shown as a whole number)
    measured = [
        ("Packet rate", rate, F.col("base_packet_rate"), False),
        ("Destination diversity", F.col("destination_ip_count"), F.col("base_destination_diversity"), True),
        ("Port diversity", F.col("destination_port_count"), F.col("base_port_diversity"), True),
    ]
    notes, ratios = [], []
    for name, now, base, whole in measured:
        ratio = now / F.nullif(base, F.lit(0.0))
        change = F.round(F.abs(ratio - 1.0) * 100.0, 9)
        common = {"name": F.lit(name), "verb": F.when(ratio > 1.0, "increased").otherwise("decreased")}
        if whole:
            shown = now.cast("int")
            moved = filled(NOTES["moved_to"], **common, base=base.cast("int"), now=shown)
        else:
            shown = fixed(now, 1)
            moved = filled(NOTES["moved_by"], **common, percent=fixed(change, 0))
        first = filled(NOTES["first"], name=F.lit(name), now=shown)
        notes.append(F.when((base == 0) & (now > 0), first).when(change >= 20.0, moved))
        ratios.append(F.coalesce(ratio, F.lit(1.0)))
    if syn_ratio is not None:
        notes.append(F.when(F.col(syn_ratio) > 0.6, F.lit(NOTES["syn"])))
    drift, most = F.col("drift_score"), F.greatest(F.lit(1.0), *ratios)
    times = F.when((drift > 0) & (most > 2.0), most).when(drift > 30, drift / 10.0)
    notes.append(filled(NOTES["deviates"], times=fixed(times, 1)))
    ready = F.col("samples") >= params.baseline_min_ticks
    return F.when(ready, compact_array(notes)).otherwise(F.array().cast("array<string>"))


def running_threat(
    alerts: DataFrame, keys: list[str], ts: str, tie: str, score: str,
    cap: int = DEFAULT.running_mean_cap, bucket_s: float = 1.0,
) -> DataFrame:
    """Alerts with ``value``: the host's threat score after each of them.

    The mean of all scores so far for the first ``cap`` alerts, then exponential with
    weight 1/cap. Prefix sums run per (host, time bucket) with bucket offsets; the
    exponential part is an affine map per bucket, chained over buckets.
    """
    bucketed = alerts.withColumn("_b", F.floor(F.col(ts) / F.lit(bucket_s)))
    sizes = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_b",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("_s0"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, tie)
    ranked = bucketed.join(offsets, [*keys, "_b"]).withColumns(
        {
            "_n": F.col("_n0") + F.row_number().over(inside),
            "_s": F.col("_s0") + F.sum(score).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    head = ranked.filter(F.col("_n") <= cap).withColumn("value", F.col("_s") / F.col("_n"))
    out = alerts.columns
    if sizes.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") > cap).limit(1).count() == 0:
        return head.select(*out, "value")

    keep = 1.0 - 1.0 / cap
    tail = ranked.filter(F.col("_n") > cap)
    local = Window.partitionBy(*keys, "_b").orderBy("_n")
    tail = tail.withColumn("_k", F.row_number().over(local))
    whole = Window.partitionBy(*keys, "_b")
    scaled = F.col(score) / cap * F.pow(F.lit(keep), -F.col("_k"))
    running = F.sum(scaled).over(local.rowsBetween(Window.unboundedPreceding, 0))
    tail = tail.withColumns({"_add": F.pow(F.lit(keep), F.col("_k")) * running, "_m": F.max("_k").over(whole)})
    ends = tail.filter(F.col("_k") == F.col("_m")).select(*keys, "_b", "_m", "_add")
    start = head.filter(F.col("_n") == cap).select(*keys, F.col("value").alias("_v"))
    fields = [f for f in ends.schema.fields if f.name in [*keys, "_b"]]
    schema = T.StructType([*fields, T.StructField("_start", T.DoubleType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b", ignore_index=True)
        value, starts = float(pdf["_v"].iloc[0]), []
        for m, add in zip(pdf["_m"], pdf["_add"], strict=True):
            starts.append(value)
            value = value * keep ** int(m) + add
        return pdf.assign(_start=starts)[[*keys, "_b", "_start"]]

    starts = ends.join(start, keys).groupBy(*keys).applyInPandas(chain, schema)
    aged = tail.join(starts, [*keys, "_b"]).withColumn(
        "value", F.col("_start") * F.pow(F.lit(keep), F.col("_k")) + F.col("_add")
    )
    return head.select(*out, "value").unionByName(aged.select(*out, "value"))


FLOW_BEHAVIOR = [
    "behavioral_drift_score",
    "historical_packet_rate",
    "historical_destination_diversity",
    "historical_protocol_usage",
    "historical_session_count",
    "historical_threat_score",
]


def behavior_columns(drift: DataFrame, threat: DataFrame | None = None) -> DataFrame:
    """The six behaviour columns per host. ``threat`` has host columns and ``value``."""
    if threat is None:
        with_threat = drift.withColumn("value", F.lit(0.0))
    else:
        with_threat = drift.join(threat.select(*HOST, "value"), HOST, "left")
    return with_threat.select(
        *HOST,
        F.col("drift_score").alias("behavioral_drift_score"),
        F.col("base_packet_rate").alias("historical_packet_rate"),
        F.col("base_destination_diversity").alias("historical_destination_diversity"),
        F.size("base_protocols").cast("double").alias("historical_protocol_usage"),
        F.col("base_session_count").alias("historical_session_count"),
        F.coalesce("value", F.lit(0.0)).alias("historical_threat_score"),
    )


def attach_behavior(flows: DataFrame, behavior: DataFrame) -> DataFrame:
    """Behaviour of the initiator for every flow at one evaluation; 0 without profile."""
    joined = flows.join(behavior, HOST, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in FLOW_BEHAVIOR})


def most_abnormal(drift: DataFrame, totals: DataFrame, n: int = 5) -> DataFrame:
    seen = totals.select(*HOST, F.col("session_count").alias("sessions"), F.col("destination_ip_count").alias("dest_diversity"))
    return (
        drift.select(*HOST, F.round("drift_score", 2).alias("drift_score"))
        .join(seen, HOST)
        .orderBy(F.col("drift_score").desc(), *HOST)
        .limit(n)
    )


def _rank(events: DataFrame, values: DataFrame, name: str, block_s: float, equal: bool) -> DataFrame:
    """``events`` with the number of ``values`` (capture, v) below their time, or up to it if ``equal``."""
    block = F.floor(F.col("ts_s") / F.lit(block_s))
    blocks = events.select("capture", block.alias("_k")).distinct().withColumn("v", F.lit(None).cast("double"))
    placed = values.select("capture", F.floor(F.col("v") / F.lit(block_s)).alias("_k"), "v")
    held = blocks.unionByName(placed).groupBy("capture", "_k").agg(F.sort_array(F.collect_list("v")).alias("_v"))
    before = Window.partitionBy("capture").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_n", F.coalesce(F.sum(F.size("_v")).over(before), F.lit(0)))
    ts = F.col("ts_s")
    here = F.size(F.filter("_v", lambda v: (v <= ts) if equal else (v < ts)))
    return events.withColumn("_k", block).join(held, ["capture", "_k"]).withColumn(name, F.col("_n") + here).drop("_k", "_v", "_n")


def swept_stats(events: DataFrame, points: DataFrame, nodes: DataFrame, window_s: float, block_s: float) -> DataFrame:
    """``points`` (host columns, ``idx``) with the drift stats of the window that ends at node
    ``idx`` of ``nodes`` (capture, node, idx), where windows overlap much.

    An event is in the windows of consecutive nodes, so it adds at the first and is taken off
    behind the last, and so does a value over the joined windows of its events: the work grows
    with the events, not with events times windows.
    """
    cuts = nodes.select("capture", (F.col("node") - F.lit(float(window_s))).alias("v"))
    seen = _rank(events, nodes.select("capture", F.col("node").alias("v")), "on", block_s, False)
    seen = stage(_rank(seen, cuts, "off", block_s, True).filter("on < off"), "swept")

    def both_ends(rows: DataFrame, *columns: str) -> DataFrame:
        ends = F.array(
            F.struct(F.col("on").alias("idx"), F.lit(1).alias("w")), F.struct(F.col("off").alias("idx"), F.lit(-1).alias("w"))
        )
        return rows.select(*HOST, *columns, F.explode(ends).alias("_e")).select(*HOST, *columns, "_e.*")

    # Seconds as decimals, so that what is taken off leaves exactly nothing.
    lasting = F.when(F.col("session_duration") > 0, F.col("session_duration").cast("decimal(25,12)"))
    plain = both_ends(seen.withColumn("lasting", lasting), "lasting").groupBy(*HOST, "idx").agg(
        F.sum("w").alias("packets"), F.sum(F.col("lasting") * F.col("w")).alias("lasted"),
        F.sum(F.when(F.col("lasting").isNotNull(), F.col("w"))).alias("sessions"),
    )
    value = F.explode(F.array(
        F.struct(F.lit("ips").alias("kind"), F.col("dst_ip").alias("value")),
        F.struct(F.lit("ports").alias("kind"), F.col("dst_port").cast("string").alias("value")),
    ))
    values = seen.select(*HOST, "on", "off", value.alias("t")).select(*HOST, "on", "off", "t.*").filter("value IS NOT NULL").distinct()
    past = F.lag("off").over(Window.partitionBy(*HOST, "kind", "value").orderBy("on", "off"))
    fresh = values.withColumn("on", F.greatest("on", past)).filter("on < off")
    spread_values = both_ends(fresh, "kind").groupBy(*HOST, "idx").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("w"))).alias(k) for k in ("ips", "ports")]
    )
    steps = plain.unionByName(spread_values, allowMissingColumns=True)
    asked = points.withColumn("_point", F.lit(True))
    # Peers included: what begins at a node counts there.
    so_far = Window.partitionBy(*HOST).orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)

    def running(c: str) -> Column:
        return F.coalesce(F.sum(c).over(so_far), F.lit(0))

    totals = (
        steps.unionByName(asked, allowMissingColumns=True)
        .withColumns({c: running(c) for c in ("packets", "lasted", "sessions", "ips", "ports")})
        .filter("_point")
    )
    mean = F.col("lasted").cast("double") / F.nullif(F.col("sessions"), F.lit(0))
    totals = totals.select(
        *points.columns, F.col("packets").alias("packet_count"), F.col("ips").alias("destination_ip_count"),
        F.col("ports").alias("destination_port_count"), F.coalesce(mean, F.lit(0.0)).alias("mean_session_duration"),
    )
    by = both_ends(seen, "protocol").groupBy(*HOST, "protocol", "idx").agg(F.sum("w").alias("w"))
    each = asked.select(*HOST, "idx", "_point").join(by.select(*HOST, "protocol").distinct(), HOST)
    each = each.unionByName(by, allowMissingColumns=True)
    counted = Window.partitionBy(*HOST, "protocol").orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)
    usage = (
        each.withColumn("c", F.sum("w").over(counted)).filter("_point AND c > 0").groupBy(*HOST, "idx")
        .agg(F.map_from_entries(F.collect_list(F.struct("protocol", "c"))).alias("protocol_usage"))
    )
    none = F.create_map().cast(NO_PROTOCOLS)
    return totals.join(usage, [*HOST, "idx"], "left").withColumn("protocol_usage", F.coalesce("protocol_usage", none))


def drift_timeline(events: DataFrame, base: DataFrame, every_s: float = 5.0, params: Params = DEFAULT) -> DataFrame:
    """(capture, src_ip, time, drift): drift of every host above 0, sampled at the first packet
    of the capture more than ``every_s`` after the last sample; time counts from the first
    such point of the capture. One column per host, with gaps filled, is a matter of display.
    """
    late = events.filter(F.col("ts_s") > every_s)
    samples = spaced_chain(late, ["capture"], "ts_s", every_s, inclusive=False)
    ready = base.filter(F.col("samples") == params.baseline_min_ticks).select(*HOST, F.col("tick").alias("_from"))
    numbered = F.row_number().over(Window.partitionBy("capture").orderBy("node")) - 1
    samples = stage(samples.select("capture", "node", numbered.alias("idx")), "samples")
    points = samples.join(checked_broadcast(ready), "capture").filter("node >= _from").select(*HOST, F.col("node").alias("at"), "idx")
    current = swept_stats(events, points, samples, params.drift_window_s, every_s)
    rest = [c for c in base.columns if c not in [*HOST, "tick"]]
    timed = base.select(*HOST, F.col("tick").alias("at"), F.struct(*rest).alias("_base"))
    marked = current.withColumn("_point", F.lit(True)).unionByName(timed, allowMissingColumns=True)
    order = Window.partitionBy(*HOST).orderBy(F.col("at"), F.col("_point").isNotNull())
    scored = (
        marked.withColumn("_base", F.last("_base", ignorenulls=True).over(order))
        .filter("_point")
        .select(*[c for c in current.columns], "_base.*")
        .withColumn("drift", drift_score(params))
        .filter("drift > 0")
    )
    first = scored.groupBy("capture").agg(F.min("at").alias("_first"))
    return scored.join(checked_broadcast(first), "capture").select(
        *HOST, (F.col("at") - F.col("_first")).alias("time"), "drift"
    )


def current_vs_baseline(drift: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return drift.select(
        *HOST,
        F.col("destination_ip_count").alias("destination_diversity"),
        "base_destination_diversity",
        F.col("destination_port_count").alias("port_diversity"),
        "base_port_diversity",
        (F.col("packet_count") / F.lit(params.drift_window_s)).alias("packet_rate"),
        "base_packet_rate",
        F.col("mean_session_duration").alias("session_duration"),
        "base_session_duration",
    )
