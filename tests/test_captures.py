"""Capture framing and header decoding on hand-made files."""

from __future__ import annotations

import dataclasses
import hashlib
import random
import struct

import pytest

from scoutlake.catalog.frames import capture_folder
from scoutlake.plans.corpus import corpus_features
from scoutlake.schemas import LAB_LOG
from scoutlake.sources import captures as ca
from scoutlake.sources import ranges


def ipv4(src, dst, proto, body, total=None, frag=0, options=b""):
    ihl = 5 + len(options) // 4
    size = total if total is not None else 20 + len(options) + len(body)
    head = struct.pack(">BBHHHBBH", 0x40 | ihl, 0, size, 0, frag, 64, proto, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + options + body


def tcp(sport, dport, bits, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, bits, 0, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def ether(ip, kind=0x0800, vlan=False):
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return b"\0" * 12 + tag + struct.pack(">H", kind) + ip


def pcap(frames, magic=b"\xd4\xc3\xb2\xa1", link=1):
    endian, unit = ranges.PCAP_MAGIC[magic]
    out = magic + struct.pack(endian + "HHiIII", 2, 4, 0, 0, 65535, link)
    for ts, f in frames:
        out += struct.pack(endian + "IIII", int(ts), round((ts % 1) / unit), len(f), len(f)) + f
    return out


def pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 65535))
    for ts, f in frames:
        ticks = round(ts * 1e6)
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


FRAMES = [
    (10.25, ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1234, 80, 2)))),
    (10.5, ether(ipv4("10.0.0.2", "10.0.0.1", 6, tcp(80, 1234, 18, b"xyz")), vlan=True)),
    (11.0, ether(b"\0" * 28, kind=0x0806)),
    (11.5, ether(ipv4("10.0.0.1", "8.8.8.8", 17, udp(5353, 53, b"q" * 33)))),
    (12.0, ether(ipv4("10.0.0.1", "8.8.8.8", 1, b"\x08\0" + b"\0" * 6) + b"\0" * 18)),
    (12.5, ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1, 2, 41), options=b"\x01" * 4))),
    (13.0, ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1, 2, 0), frag=100))),
]
EXPECTED = [
    (0, 10.25, "10.0.0.1", "10.0.0.2", 1234, 80, 6, 20, "S"),
    (1, 10.5, "10.0.0.2", "10.0.0.1", 80, 1234, 6, 23, "SA"),
    (3, 11.5, "10.0.0.1", "8.8.8.8", 5353, 53, 17, 41, ""),
    (4, 12.0, "10.0.0.1", "8.8.8.8", 0, 0, 1, 8, ""),
    (5, 12.5, "10.0.0.1", "10.0.0.2", 1, 2, 6, 20, "FPU"),
    (6, 13.0, "10.0.0.1", "10.0.0.2", 0, 0, 6, 20, ""),
]


@pytest.mark.parametrize("kind", ["le", "be", "nano", "ng"])
def test_decode(spark, tmp_path, kind):
    data = {
        "le": lambda: pcap(FRAMES),
        "be": lambda: pcap(FRAMES, b"\xa1\xb2\xc3\xd4"),
        "nano": lambda: pcap(FRAMES, b"\x4d\x3c\xb2\xa1"),
        "ng": lambda: pcapng(FRAMES),
    }[kind]()
    (tmp_path / "a.pcap").write_bytes(data)
    rows = ca.read_captures(spark, str(tmp_path)).orderBy("pkt_id").collect()
    assert [tuple(r)[1:] for r in rows] == EXPECTED
    assert {r["capture"] for r in rows} == {"a.pcap"}
    few = ca.read_captures(spark, str(tmp_path), max_packets=2)
    assert [r["pkt_id"] for r in few.orderBy("pkt_id").collect()] == [0, 1]


def test_raw_ip_and_truncated_tail(spark, tmp_path):
    frames = [(1.0, ipv4("1.2.3.4", "5.6.7.8", 6, tcp(9, 10, 16)))] * 2
    (tmp_path / "raw.pcap").write_bytes(pcap(frames, link=101)[:-5])
    rows = ca.read_captures(spark, str(tmp_path)).collect()
    assert [tuple(r)[3:] for r in rows] == [("1.2.3.4", "5.6.7.8", 9, 10, 6, 20, "A")]


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pcap").write_bytes(pcap(FRAMES))
    rows = ca.read_captures(spark, f"{tmp_path}/*")
    assert rows.select("capture").distinct().count() == 2
    assert rows.count() == rows.select("capture", "pkt_id").distinct().count() > 0
    one = ca.read_captures(spark, f"{tmp_path}/a/x.pcap").select("capture").distinct().collect()
    assert [r["capture"] for r in one] == ["x.pcap"]


def test_metadata_hash_and_leading_bytes(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES))
    (tmp_path / "empty.pcap").write_bytes(pcap([]))
    (tmp_path / "page.csv").write_bytes(b"<!DOCTYPE html><html>not a table")
    files = ca.capture_files(spark, str(tmp_path))
    meta = {r["capture"]: r for r in ca.capture_metadata(ca.read_captures(spark, str(tmp_path)), files).collect()}
    a = meta["a.pcap"]
    assert (a["total_packets"], a["unique_ips_count"], a["tcp"], a["udp"], a["other"]) == (6, 3, 4, 1, 1)
    assert a["duration_seconds"] == 2.75 and a["start_time_utc"] == "1970-01-01 00:00:10 UTC"
    assert meta["empty.pcap"]["total_packets"] == 0 and meta["empty.pcap"]["end_time_utc"] == "N/A"
    hashes = {r["file"]: r["sha256"] for r in ca.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes["a.pcap"] == hashlib.sha256(pcap(FRAMES)).hexdigest()
    heads = {r["file"]: r["status"] for r in ca.leading_bytes(spark, str(tmp_path)).collect()}
    assert heads == {"a.pcap": "OK", "empty.pcap": "OK", "page.csv": "CORRUPTED_HTML_DOWNLOAD"}


def test_corpus_is_labelled_by_file(spark, tmp_path):
    scan = [(i * 0.5, ether(ipv4("10.0.0.50", "10.0.0.2", 6, tcp(5000 + i, 20 + i, 2)))) for i in range(10)]
    (tmp_path / "scan.pcap").write_bytes(pcap(scan))
    (tmp_path / "other.pcap").write_bytes(pcap(FRAMES))
    row = dict.fromkeys(LAB_LOG.names) | {"pcap_filename": "scan.pcap", "label": 1, "attack_type": "SYN Scan"}
    log = spark.createDataFrame([tuple(row[n] for n in LAB_LOG.names)], LAB_LOG)
    table = corpus_features(spark, str(tmp_path), log)
    got = {(r["pcap_filename"], r["label"], r["attack_type"], r["dataset"]) for r in table.collect()}
    assert got == {("scan.pcap", 1, "SYN Scan", "lab"), ("other.pcap", None, "unknown", "lab")}
    assert table.filter("pcap_filename = 'scan.pcap'").first()["host_port_entropy"] == pytest.approx(3.321928, abs=1e-6)


def rows_of(spark, folder, range_bytes):
    frames = ca.read_frames(spark, str(folder), range_bytes=range_bytes)
    return sorted((r.capture, r.pkt_id, r.ts_s, r.linktype, bytes(r.frame)) for r in frames.collect()), frames


def many(n, seed=0):
    rng = random.Random(seed)
    return [(1000 + i * 0.25, ether(ipv4("10.0.0.1", "8.8.8.8", 17, udp(i, 53, rng.randbytes(rng.randrange(900)))))) for i in range(n)]


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_a_file_in_ranges_gives_the_same_rows(spark, tmp_path, kind):
    """Also where a packet holds a whole capture, and a record is longer than a range."""
    inner = {"pcap": pcap, "pcapng": pcapng}[kind](many(60, 1))
    inner += b"\0" * (-len(inner) % 4)
    frames = many(200)
    frames[70] = (frames[70][0], ether(inner[24 if kind == "pcap" else 28 :]))
    frames[120] = (frames[120][0], ether(b"z" * 20_000))
    data = {"pcap": pcap, "pcapng": pcapng}[kind](frames)
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "b.pcap").write_bytes(data[:-7])
    (tmp_path / "c.pcap").write_bytes(data[:24])
    (tmp_path / "d.pcap").write_bytes(b"")
    (tmp_path / "e.pcap").write_bytes(b"no capture at all")
    whole, _ = rows_of(spark, tmp_path, 1 << 30)
    assert [r[4] for r in whole if r[0] == "a.pcap"] == [f for _, f in frames]
    assert [r[1] for r in whole if r[0] == "a.pcap"] == list(range(200)) and sum(r[0] == "b.pcap" for r in whole) == 199
    for size in (len(data) // 8 + 1, 4096, 1000):
        cut, frame = rows_of(spark, tmp_path, size)
        assert cut == whole
        assert frame.rdd.getNumPartitions() > 1


def test_sections_and_interfaces_inside_a_file(spark, tmp_path):
    """Each section brings its own interfaces; ranges after them use the right ones."""
    first, second = pcapng(many(50)), pcapng(many(50, 3)).replace(struct.pack("<IIHHI", 1, 20, 1, 0, 65535), struct.pack("<IIHHI", 1, 20, 101, 0, 65535))
    (tmp_path / "a.pcapng").write_bytes(first + second)
    cut, _ = rows_of(spark, tmp_path, 3000)
    assert [r[3] for r in cut] == [1] * 50 + [101] * 50 and [r[1] for r in cut] == list(range(100))


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """Sparse: 150 frames of 15 MB, an address in each."""
    size = 15 << 20
    with open(tmp_path / "big.pcap", "wb") as out:
        out.write(pcap([]))
        for i in range(150):
            head = ether(ipv4("10.0.0.1", f"10.0.1.{i}", 17, udp(i, 53), total=1000))
            out.write(struct.pack("<IIII", 1000 + i, 0, size, size) + head)
            out.seek(size - len(head), 1)
        out.truncate(out.tell())
    assert (tmp_path / "big.pcap").stat().st_size > 2**31
    packets = ca.read_captures(spark, str(tmp_path))
    got = packets.orderBy("pkt_id").select("pkt_id", "dst_ip", "payload_len").collect()
    assert [tuple(r) for r in got] == [(i, f"10.0.1.{i}", 980) for i in range(150)]


def test_first_packets_of_each_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES * 5))
    monkeypatch.setattr(ca, "DEFAULT", dataclasses.replace(ca.DEFAULT, chunk_rows=4))
    few = ca.read_captures(spark, str(tmp_path), max_packets=9).orderBy("pkt_id").collect()
    assert [r["pkt_id"] for r in few] == [i for i in range(35) if i % 7 != 2][:9]


def test_times_between_two_microseconds_round_up(spark, packets):
    times = [0.5e-6, 2.5e-6, 3.5e-6, 10.25]
    rows = packets([(t, "10.0.0.1", 1, "10.0.0.2", 2, 6, 10, "S") for t in times])
    read = ca.read_captures(spark, capture_folder(rows, 10))
    assert [round(r[0] * 1e6) for r in read.orderBy("pkt_id").select("ts_s").collect()] == [1, 3, 4, 10250000]
