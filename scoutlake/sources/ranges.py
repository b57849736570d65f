"""Capture files of any size, cut into byte ranges that are read apart.

A first look at every range guesses where its first record begins (a chain of plausible
records), walks to the first record beyond the range and counts. The ranges of a file are
then linked: each must begin where the one before ended. A range whose guess was wrong, say
inside a capture that was itself captured, is walked again from the right place. So the cut
is exact, and numbers the records as one walk over the whole file would.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.session import stage

RANGE_BYTES = 128 << 20
WINDOW = 1 << 20  # bytes read at once
CHAIN = 6  # records in a row that look right
LARGEST = 1 << 26  # bytes of a plausible record
YEARS = 20 * 366 * 86400  # from the file's first record to any other

# File magics, block kinds.
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6),
    b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9),
    b"\xa1\xb2\x3c\x4d": (">", 1e-9),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6


def open_bytes(path: str):
    """File object of a path as Spark gives it, on any file system that Arrow knows."""
    if path.startswith("file:") or path.startswith("/"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


class Bytes:
    """Random access through one window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, WINDOW))
        return self.data[at - self.at : at - self.at + n]


@dataclass
class State:
    """What a reader must know of all that stands before a place."""

    endian: str = "<"
    links: list = field(default_factory=list)  # (link type, seconds of a tick) by interface

    def text(self) -> str:
        return json.dumps([self.endian, self.links])

    @classmethod
    def of(cls, text: str) -> State:
        endian, links = json.loads(text)
        return cls(endian, [tuple(x) for x in links])


def _resolution(options: bytes, endian: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(endian + "HH", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and at + 4 < len(options):
            raw = options[at + 4]
            return 2.0 ** -(raw & 0x7F) if raw & 0x80 else 10.0**-raw
        at += 4 + size + (-size) % 4
    return 1e-6


class Pcap:
    """Records behind a header of 24 bytes."""

    def __init__(self, src: Bytes):
        head = src.get(0, 24)
        self.src, self.begin = src, 24
        self.endian, self.unit = PCAP_MAGIC[head[:4]]
        self.link = struct.unpack(self.endian + "I", head[20:24])[0] & 0x0FFFFFFF if len(head) == 24 else 0
        first = src.get(24, 16)
        self.epoch = struct.unpack(self.endian + "I", first[:4])[0] if len(first) == 16 else 0

    def likely(self, at: int) -> int | None:
        """Where the next record would begin if one that looks right begins here."""
        head = self.src.get(at, 16)
        if len(head) < 16:
            return None
        sec, frac, kept, size = struct.unpack(self.endian + "IIII", head)
        if frac * self.unit >= 1 or abs(sec - self.epoch) > YEARS or kept > min(size, LARGEST) or size == 0:
            return None
        return at + 16 + kept

    def records(self, at: int, stop: int, state: State) -> Iterator[tuple[int, tuple | None]]:
        """(place of the next record, (seconds, link type, frame)) of the records that begin before ``stop``."""
        src, endian, unit, link = self.src, self.endian, self.unit, self.link
        while at < stop:
            head = src.get(at, 16)
            if len(head) < 16:
                return
            sec, frac, size, _ = struct.unpack(endian + "IIII", head)
            if at + 16 + size > src.size:
                return
            frame = src.get(at + 16, size)
            at += 16 + size
            yield at, (sec + frac * unit, link, frame)


class PcapNg:
    """Blocks; sections and interfaces change what the packets after them mean."""

    def __init__(self, src: Bytes):
        self.src, self.begin = src, 0
        self.endian = "<" if src.get(8, 4) == b"\x4d\x3c\x2b\x1a" else ">"

    def likely(self, at: int) -> int | None:
        head = self.src.get(at, 8)
        if at % 4 or len(head) < 8:
            return None
        kind, size = struct.unpack(self.endian + "II", head)
        if size % 4 or not 12 <= size <= LARGEST or kind not in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, SECTION, 0xBAD, 0x40000BAD):
            return None
        tail = self.src.get(at + size - 4, 4)
        return at + size if tail == head[4:] else None

    def records(self, at: int, stop: int, state: State) -> Iterator[tuple[int, tuple | None]]:
        src = self.src
        while at < stop:
            head = src.get(at, 12)
            if len(head) < 12:
                return
            if head[:4] == PCAPNG_MAGIC:
                state.endian = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
                state.links = [("section", 0)]  # replaces what was before, see ``followed``
            kind, size = struct.unpack(state.endian + "II", head[:8])
            if size < 12 or at + size > src.size:
                return
            body = src.get(at + 8, size - 12) if kind in (INTERFACE, PACKET) else b""
            at += size
            if kind == INTERFACE and len(body) >= 8:
                state.links.append((struct.unpack(state.endian + "H", body[:2])[0], _resolution(body[8:], state.endian)))
            if kind == PACKET and len(body) >= 20:
                port, high, low, kept, _ = struct.unpack(state.endian + "IIIII", body[:20])
                links = state.links[1:] if state.links[:1] == [("section", 0)] else state.links
                link, unit = links[port] if port < len(links) else (None, 0.0)
                yield at, (((high << 32) | low) * unit, link, body[20 : 20 + kept])
            else:
                yield at, None


def followed(before: State, after: State) -> State:
    """State behind a range, of the state before it and what the range itself told."""
    if after.links[:1] == [("section", 0)]:
        return State(after.endian, after.links[1:])
    return State(after.endian, before.links + after.links)


def reader(src: Bytes):
    magic = src.get(0, 4)
    return Pcap(src) if magic in PCAP_MAGIC else PcapNg(src) if magic == PCAPNG_MAGIC else None


def guessed(own, begin: int, end: int) -> int | None:
    """First place in a range from which on ``CHAIN`` records look right, or all to the end of the file."""
    if begin <= own.begin:
        return own.begin
    for start in range(begin, min(end, own.src.size)):
        at, seen = start, 0
        while at is not None and seen < CHAIN and at < own.src.size:
            at, seen = own.likely(at), seen + 1
        if at is not None and at <= own.src.size:
            return start
    return None


def walked(own, start: int | None, end: int, endian: str | None = None) -> tuple[int, int, State]:
    """(next, records, told) of the records from ``start`` on that begin before ``end``."""
    told, at, n = State(endian or own.endian), start if start is not None else -1, 0
    for at, record in own.records(at, end, told) if start is not None else ():  # noqa: B007
        n += record is not None
    return at, n, told


LOOKED = "path string, capture string, length long, k int, begin long, end long, start long, next long, n long, told string"
PLANNED = "path string, capture string, length long, k int, start long, end long, first long, n long, state string"


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            with open_bytes(r.path) as file:
                own = reader(Bytes(file, r.length))
                if own is not None:
                    start = guessed(own, r.begin, r.end)
                    at, n, told = walked(own, start, r.end)
                    rows.append((*r, -1 if start is None else start, at, n, told.text()))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOOKED.split(", ")])


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file in order, each from where the one before ended."""
    rows, at, first, state = [], None, 0, None
    for r in pdf.sort_values("k").itertuples(index=False):
        told, nxt, n = State.of(r.told), r.next, r.n
        if state is None:
            at, state = r.start, State(told.endian)
        if at >= r.end:  # a record covers the whole range
            continue
        if r.start != at or (state.links and told.endian != state.endian and told.links[:1] != [("section", 0)]):
            with open_bytes(r.path) as file:
                nxt, n, told = walked(reader(Bytes(file, r.length)), at, r.end, state.endian)
        rows.append((r.path, r.capture, r.length, r.k, at, r.end, first, n, state.text()))
        stuck = nxt <= at or nxt < r.end  # a cut or broken record: nothing follows
        at, first, state = nxt, first + n, followed(state, told)
        if stuck:
            break
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PLANNED.split(", ")])


def planned_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges with their first record's place and number, from files (path, capture, length)."""
    last = F.expr(f"greatest(0, length - 1) div {int(range_bytes)}").cast("int")
    parts = files.select("path", "capture", "length", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    begin = F.col("k").cast("long") * range_bytes
    parts = parts.select("*", begin.alias("begin"), F.least(begin + range_bytes, "length").alias("end"))
    parts = stage(parts, "ranges")
    looked = spread(parts).mapInPandas(_look, LOOKED)
    return stage(looked.groupBy("path").applyInPandas(_link, PLANNED), "planned")


def spread(parts: DataFrame, most: int = 20_000) -> DataFrame:
    """A task for every few ranges."""
    return parts.repartition(max(1, min(parts.count(), most)), "path", "k")


def records_in(path: str, length: int, start: int, end: int, state: str) -> Iterator[tuple[float, int, bytes]]:
    """(seconds, link type, frame) of the records that begin in [start, end)."""
    with open_bytes(path) as file:
        for _, record in reader(Bytes(file, length)).records(start, end, State.of(state)):
            if record is not None:
                yield record
