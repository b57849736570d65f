"""Words and hashes straight from Arrow buffers; several text operators share this.

A word is a maximal run of characters other than space and \\x09-\\x0D. In UTF-8 these
separators and A-Z never occur inside a longer character, so words are found, lower-cased
and hashed on whole byte buffers, without a Python object per word. Texts are taken in
slices of some megabytes and hashed in blocks cut at separators: memory does not grow with
a text beyond its bytes and a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SLICE = 4 << 20  # bytes of text handled at once
BLOCK = 1 << 18  # bytes hashed at once
PIECE = 1 << 16  # words whose shingles are built at once

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


# Rolling hash: a random number per byte, times a power of an odd base, modulo 2**64.
_BASE = 0xD1B54A32D192ED03
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
POWER = _powers(_BASE, 2 * BLOCK)
INVERSE = _powers(pow(_BASE, -1, 2**64), 2 * BLOCK)


def rolled(data: np.ndarray) -> np.ndarray:
    """Prefix sums; bytes [i, j) hash to (sums[j] - sums[i]) * INVERSE[i]. At most 2 * BLOCK bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * POWER[: len(data)], out=sums[1:])
    return sums


@dataclass
class Slice:
    """Some rows of a batch: bytes, words and where each text begins."""

    row: int  # of its first text in the batch
    data: np.ndarray  # bytes of all texts
    byte_offsets: np.ndarray  # of each text in data, and the end
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    offsets: np.ndarray  # of each text in the words, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same in every process."""
        return span_hashes(self.data, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans follow each other without overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(int(np.searchsorted(ends, first + BLOCK, "right")), at + 1)
        if ends[to - 1] - first > BLOCK:  # one span longer than a block
            out[at] = _long_hash(data[first : ends[at]])
            at += 1
            continue
        sums = rolled(data[first : ends[to - 1]])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (sums[e] - sums[s]) * INVERSE[s] + (e - s).astype(np.uint64)
        at = to
    return mixed(out)


def _long_hash(data: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total = (total + int(rolled(part)[-1]) * scale) % 2**64
        scale = scale * pow(_BASE, BLOCK, 2**64) % 2**64
    return np.uint64((total + len(data)) % 2**64)


def slices(batch: pa.RecordBatch | pa.StructArray, column: str = "text", lower: bool = True, size: int | None = None) -> Iterator[Slice]:
    """The texts of a batch, or of its rows as structs, in slices; a null is an empty text."""
    size = size or SLICE
    texts = batch.field(column) if isinstance(batch, pa.StructArray) else batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    edges = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    edges = edges[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(int(np.searchsorted(edges, edges[row] + size, "right")) - 1, row + 1)
        data = raw[edges[row] : edges[to]]
        yield _slice(row, LOWER[data] if lower else data, edges[row : to + 1] - edges[row])
        row = to


def _slice(row: int, data: np.ndarray, edges: np.ndarray) -> Slice:
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    border = edges[(edges > 0) & (edges < len(data))]  # words end with their text
    begins[border] |= inside[border]
    finishes[border - 1] |= inside[border - 1]
    starts = np.flatnonzero(begins)
    return Slice(row, data, edges, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, edges))


def shingles(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the ``size``-word shingles of each text in order; a text with fewer
    words is one shingle of all of them, a text without words has none."""
    h = part.hashes()
    n = np.diff(part.offsets)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(offsets[-1]) + np.repeat(part.offsets[:-1] - offsets[:-1], counts)
    width = np.repeat(np.minimum(n, size), counts)
    out = width.astype(np.uint64)
    for k in range(size):
        more = h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else h
        out = np.where(k < width, mixed(out * GOLDEN + more), out)
    return out, offsets


def pieces(part: Slice) -> Iterator[Slice]:
    """The texts of a slice in smaller ones of about ``PIECE`` words, over the same bytes."""
    row = 0
    while row < len(part):
        to = max(int(np.searchsorted(part.offsets, part.offsets[row] + PIECE, "right")) - 1, row + 1)
        a, b = part.offsets[row], part.offsets[to]
        yield Slice(part.row + row, part.data, part.byte_offsets[row : to + 1], part.starts[a:b], part.ends[a:b], part.offsets[row : to + 1] - a)
        row = to


def shingle_sets(part: Slice, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    sets = []
    for piece in pieces(part):
        found, offsets = shingles(piece, size)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            s = np.sort(found[a:b])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            sets.append(s)
    return sets


class Lookup:
    """Place of 64-bit hashes in a sorted array, -1 where absent; vectorised bucket search."""

    def __init__(self, ordered: np.ndarray):
        self.ordered = np.append(ordered, np.uint64(2**64 - 1))
        self.bits = max(1, int(len(ordered)).bit_length())
        self.shift = np.uint64(64 - self.bits)
        heads = np.arange(2**self.bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(ordered, heads).astype(np.int32)
        widest = np.diff(np.append(self.first, len(ordered))).max()
        self.steps = int(widest)
        self.n = len(ordered)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.first[h >> self.shift].astype(np.int64)
        for _ in range(self.steps):
            at += self.ordered[at] < h
        return np.where((self.ordered[at] == h) & (at < self.n), at, -1)


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows with the highest counts, at most ``most`` of them: all from a limit on, which a
    histogram of the counts gives, so no task and no driver orders the rows."""
    binned = df.withColumn("_bin", F.floor(F.log2(count) * 16))
    total, limit = 0, None
    for row in sorted(binned.groupBy("_bin").count().collect(), key=lambda r: -r["_bin"]):
        total += row["count"]
        if total > most:
            break
        limit = row["_bin"]
    kept = binned.where(F.col("_bin") >= limit) if limit is not None else binned.where("false")
    return kept.drop("_bin")


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """Arrow lists; uint64 values keep their bits."""
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(kind)))


def release() -> None:
    """Give memory no longer used back to the system: Spark keeps a task's Python process for
    later tasks, and meanwhile the JVM works beside it."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # the one of numpy's arrays, too


def arrow_map(
    df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """mapInArrow with a function per batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)
        batch = None
        release()

    return df.mapInArrow(run, schema)
