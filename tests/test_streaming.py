"""Streams over files in pieces give the batch result."""

from __future__ import annotations

import time

import pytest
from traffic import SF, syn_scan
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutlake.operators import behavior as be
from scoutlake.operators.alerts import cool_down
from scoutlake.operators.flows import assemble_flows
from scoutlake.operators.hosts import feature_table
from scoutlake.plans import behavior as plan
from scoutlake.session import new_folder, stage
from scoutlake.sources import replay
from scoutlake.sources.events_view import read_packets
from scoutlake.streaming import flows as sf
from scoutlake.streaming import live, queries, state


@pytest.fixture
def pieces(spark):
    def build(df, ts, n=4):
        path = new_folder(spark, "pieces")
        replay.write_in_order(df, path, ts, n)
        return replay.packet_stream(spark, path, df.schema, files_per_trigger=1)

    return build


def test_closed_flows(spark, pieces):
    packets = read_packets(spark, SF)
    closed = queries.drain_whole(pieces(packets, "ts_s"), sf.closed_flows, "closed")
    names = ["flow_id", "packets", "bytes", "syn", "ack", "start_s", "end_s", "fwd_packets"]
    want = assemble_flows(packets, timeout_s=60.0)
    assert closed.count() > 100
    assert closed.select(names).exceptAll(want.select(names)).count() == 0
    assert want.select(names).exceptAll(closed.select(names)).count() == 0


def test_windows_end_at_whole_seconds(spark, pieces, packets):
    rows = packets([(t, "10.0.0.1", 1, "10.0.0.2", 2, 6, 10, "S") for t in (0.25, 0.9999998, 1.0, 4.9999997, 5.000001)])
    tumbling = queries.drain_whole(pieces(rows, "ts_s", 1), sf.tumbling_counts, "tumbling")
    assert sorted(tuple(r) for r in tumbling.collect()) == [(0, 2), (1, 1), (4, 1), (5, 1)]
    sliding = queries.drain_whole(pieces(rows, "ts_s", 1), sf.sliding_hosts, "sliding")
    got = {r["window_start"]: r["packets"] for r in sliding.collect()}
    assert got == {5: 1, 0: 5, -5: 5, -10: 5, -15: 5, -20: 5, -25: 4}


def test_tracked_flows_have_the_batch_intervals(spark, pieces, packets):
    table = read_packets(spark, SF)
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(pieces(table, "ts_s"), sf.tracked_flows, "tracked")
    names = ["flow_id", "packets", "bytes", "syn", "ack", "fwd_packets", "bwd_packets", "start_s", "end_s"]
    names += [F.round(c, 6).alias(c) for c in ("interval_mean", "interval_var", "size_var")]
    want = assemble_flows(table, timeout_s=60.0).select(names)
    assert got.count() == want.count() > 100
    assert got.select(names).exceptAll(want).count() == 0

    # One flow: many packets a second, silences just within and just beyond the timeout.
    steps = [0.0, *[0.001 * k for k in range(1, 400)], 60.399, 61.0, 121.0, 181.5, 181.6, 300.0]
    hot = packets([(t, "10.0.0.1", 4000, "10.0.0.2", 80, 6, 20 + k % 7, "A") for k, t in enumerate(steps)])
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(pieces(hot, "ts_s", 5), sf.tracked_flows, "hot")
    want = assemble_flows(hot, timeout_s=60.0)
    assert got.count() == want.count() == 3
    assert got.select(names).exceptAll(want.select(names)).count() == 0


class Cell:
    """Value state in memory."""

    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_many_short_flows_cost_little_each(packets):
    """Keys with few rows are the most; each takes well below a millisecond (a frame per key took about ten)."""
    blocks = sf.flow_blocks(sf.with_flow_key(replay.with_event_time(packets(syn_scan(n=1)))))
    row = T.StructType([f for f in blocks.schema.fields if f.name in sf.MERGE or f.name in sf.GAPS])
    out = T.StructType([*row.fields, *(T.StructField(c, T.DoubleType()) for c in ("interval_mean", "interval_var"))])
    one = blocks.select(row.names).first().asDict()
    block = {k: [tuple((one | {"start_s": k + t, "end_s": k + t + 0.25}).values()) for t in (0.0, 2.0, 100.0)] for k in range(5000)}
    tracker, begin, gaps = sf.FlowTracker(row, out, 60.0), time.process_time(), []
    for rows in block.values():
        tracker.open = Cell()
        gaps += [dict(zip(out.names, r, strict=True))["interval_mean"] for r in tracker.ordered(tuple(sf.KEY), rows)]
    assert gaps == [1.75] * 5000
    assert time.process_time() - begin < 10


def test_tracked_flows_out_of_order(spark):
    """Packets up to the delay late are put in place; numbers in order of time give the batch result."""
    times = [100, 40, 130, 10, 400, 390]
    schema = "capture string, pkt_id bigint, ts_s double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, payload_len int, flags string"
    stream = out_of_order(spark, times, schema, lambda i, t: ("c", int(t), t, "a", "b", 1, 2, 6, 20, "A"))
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(stream, lambda rows: sf.tracked_flows(rows, 60.0, "200 seconds"), "late").orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.packets, r.interval_mean, r.interval_var) for r in got] == [(10.0, 130.0, 4, 40.0, pytest.approx(200.0)), (390.0, 400.0, 2, 10.0, 0.0)]


def test_cool_down(spark, pieces):
    rows = stage(assemble_flows(read_packets(spark, SF), timeout_s=60.0), "alerts").select("src_ip", "end_s", "first_id")
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(
            pieces(rows, "end_s"), lambda r: state.cool_down_stream(r, ["src_ip"], "end_s", "first_id"), "passed", "end_s"
        )
    want = cool_down(rows, ["src_ip"], "end_s", "first_id")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_profiles(spark, pieces):
    p = plan.build(read_packets(spark, SF))
    events = p.events.withColumns({c: F.col(c).cast("bigint") for c in ["bytes_len", "dst_port"]})
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(pieces(events, "ts_s"), state.profile_stream, "profiles")
    want = be.snapshots(p.events, p.ticks, p.base).withColumnRenamed("timestamp", "tick")
    names = ["src_ip", "samples", "destination_diversity", "port_diversity", *[F.round(c, 6).alias(c) for c in ["tick", "packet_rate", "drift_score"]]]
    assert got.count() == want.count() > 50
    assert got.select(names).exceptAll(want.select(names)).count() == 0


def out_of_order(spark, times, schema, row):
    """One file per time, in the given order of arrival."""
    path = new_folder(spark, "late")
    for i, t in enumerate(times):
        spark.createDataFrame([row(i, float(t))], schema).coalesce(1).write.mode("append").parquet(path)
    return replay.packet_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_cool_down_out_of_order(spark):
    times = [100, 40, 130, 10, 400, 390, 5]  # 5 comes later than the delay allows
    stream = out_of_order(spark, times, "src_ip string, end_s double, first_id bigint", lambda i, t: ("a", t, i))
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(
            stream, lambda r: state.cool_down_stream(r, ["src_ip"], "end_s", "first_id", 60.0, "200 seconds"), "late", "end_s"
        )
    assert sorted(r["end_s"] for r in got.collect()) == [10.0, 100.0, 390.0]


def test_profiles_out_of_order(spark):
    times = [*range(0, 421, 70), 300, 490]
    schema = "capture string, src_ip string, pkt_id bigint, " + state.EVENT.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    stream = out_of_order(spark, times, schema, lambda i, t: ("c", "h", i, t, 10, "TCP", "d", 80, "s", 0.0))
    with queries.rocksdb_state(spark):
        got = queries.drain_whole(stream, lambda r: state.profile_stream(r, delay="200 seconds"), "late")
    rates = {r["tick"]: r["packet_rate"] for r in got.collect()}
    # The late event lies between two ticks and belongs to the second of them.
    assert rates[490.0] == pytest.approx(2 / 70) and rates[350.0] == pytest.approx(3 / 70)


def test_live_evaluation_per_capture_and_segment(spark, packets):
    old = packets(syn_scan(n=25), capture="old")
    new = packets([(t + 1000.0, *rest) for t, *rest in syn_scan(n=25)], capture="new")
    detector = live.LiveDetector(spark, new_folder(spark, "live"))
    detector(old.unionByName(new), 0)
    fields = "capture string, source_ip string, severity string, threat_confidence double"
    both = {r["capture"]: r["count"] for r in detector.alerts(fields).groupBy("capture").count().collect()}
    assert both["old"] == both["new"] > 0

    pairs = packets([(t, "10.0.0.1", 4000, "10.0.0.2", 80, 6, 20, "S") for t in (0.0, 1.0, 100.0, 101.0)])
    cut = assemble_flows(pairs, timeout_s=60.0).filter("segment = 1")
    row = feature_table(pairs, cut, wide=True, segmented=True).first()
    assert row["host_interval_var"] == 0.0


def test_live_detection_raises_the_scan_and_survives_a_rerun(spark, packets):
    quiet = [(0.1 * i, "10.0.0.9", 4000, "10.0.0.2", 80, 6, 20, "SA") for i in range(5)]
    table = packets(sorted([*syn_scan(n=25), *quiet]))
    detector = live.LiveDetector(spark, new_folder(spark, "live"))
    half = table.filter("ts_s < 6")
    detector(half, 0)
    detector(table.filter("ts_s >= 6"), 1)
    fields = "capture string, source_ip string, severity string, threat_confidence double"
    once = detector.alerts(fields).groupBy("batch", "source_ip").count().orderBy("batch").collect()
    assert [(r["batch"], r["source_ip"], r["count"]) for r in once] == [(0, "10.0.0.50", 12), (1, "10.0.0.50", 25)]
    detector(table.filter("ts_s >= 6"), 1)
    again = detector.alerts(fields).groupBy("batch", "source_ip").count().orderBy("batch").collect()
    assert again == once
    assert detector.host_threat(fields).first()["alerts"] == 37


def test_bounded_run_and_progress(spark, pieces):
    stream = pieces(read_packets(spark, SF), "ts_s")
    run = queries.each_batch(stream, lambda df, n: df.count(), new_folder(spark, "bounded"))
    steps = queries.progress(queries.finish(run, 60.0))
    assert not run.isActive and sum(s["input_rows"] for s in steps) == 1000
