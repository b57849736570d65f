"""Hashed subwords (byte n-grams of a word between its two borders) and their embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.words import BLOCK, GOLDEN, INVERSE, Slice, release, rolled


def subwords(part: Slice, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of every subword, in pieces. Words are those of the slice in order."""
    lengths = part.ends - part.starts
    if not len(lengths):
        return
    room = np.concatenate([[0], np.cumsum(lengths + 1)])  # each word after one border byte
    data = np.empty(room[-1] + 1, np.uint8)
    border = np.zeros(len(data), bool)
    border[room] = True
    data[border] = 0x20
    inside = np.zeros(len(part.data) + 1, np.int8)
    inside[part.starts] += 1
    inside[part.ends] -= 1
    data[~border] = part.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    word = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths + 1)
    shift = np.uint64(64 - bits)
    for a in range(0, len(word), BLOCK):
        b = min(a + BLOCK, len(word))
        sums = rolled(data[a : min(b + max(sizes), len(data))])
        at = np.arange(b - a)
        last = room[word[a:b] + 1] - a  # the border after the word
        for n in sizes:
            i = at[at + n - 1 <= last]
            h = (sums[i + n] - sums[i]) * INVERSE[i] + np.uint64(n)
            yield word[a + i], ((h * GOLDEN) >> shift).astype(np.int64)


def word_sums(part: Slice, table: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the sum of its subwords' rows of ``table`` (buckets x columns), and their number."""
    n = len(part.starts)
    sums = np.zeros((n, table.shape[1]))
    counts = np.zeros(n)
    for word, bucket in subwords(part, sizes, bits):
        low = word[0] if len(word) else 0
        wide = int(word[-1] - low) + 1 if len(word) else 0
        local = word - low
        counts[low : low + wide] += np.bincount(local, minlength=wide)
        rows = table[bucket]
        for c in range(table.shape[1]):
            sums[low : low + wide, c] += np.bincount(local, rows[:, c], wide)
    return sums, counts


def text_sums(values: np.ndarray, part: Slice) -> np.ndarray:
    """Sums of word values per text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[part.offsets[1:]] - total[part.offsets[:-1]]


@dataclass
class Bags:
    """Instances as bags of buckets: (buckets, counts) of instance k lie at edges[k:k+2]."""

    edges: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, instance: np.ndarray, bucket: np.ndarray, n: int, bits: int) -> Bags:
        key = np.sort(instance.astype(np.int64) << bits | bucket)
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        counts = np.diff(np.append(heads, len(key))).astype(np.float32)
        key = key[heads]
        return cls(np.searchsorted(key >> bits, np.arange(n + 1)), (key & ((1 << bits) - 1)).astype(np.int32), counts)

    @classmethod
    def joined(cls, parts: list[Bags]) -> Bags:
        """The instances of all parts, one part after another."""
        before = np.cumsum([0, *(p.edges[-1] for p in parts)])
        edges = [np.zeros(1, np.int64), *(p.edges[1:] + b for p, b in zip(parts, before, strict=False))]
        return cls(np.concatenate(edges), *(np.concatenate([getattr(p, k) for p in parts]) for k in ("buckets", "counts")))

    def take(self, rows: np.ndarray):
        """(edges, buckets, weights) of some instances, weights summing to one in each."""
        sizes = self.edges[rows + 1] - self.edges[rows]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(edges[-1]) + np.repeat(self.edges[rows] - edges[:-1], sizes)
        counts = self.counts[at]
        inst = np.repeat(np.arange(len(rows)), sizes)
        return inst, self.buckets[at], counts / np.bincount(inst, counts, len(rows))[inst]


class Softmax:
    """Averaged subword embeddings under a linear softmax, by stochastic gradient descent."""

    def __init__(self, bits: int, dims: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.emb = (rng.random((1 << bits, dims), dtype=np.float32) - 0.5) / dims
        self.out = np.zeros((dims, classes), np.float32)
        self.bias = np.zeros(classes, np.float32)
        self.rng = rng

    def epoch(self, bags: Bags, rows: np.ndarray, labels: np.ndarray, rate: float, batch: int = 64) -> None:
        order = self.rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            self._step(*bags.take(rows[some]), labels[some], rate)

    def _step(self, inst, buckets, weights, labels, rate) -> None:
        n = len(labels)
        x = np.zeros((n, self.emb.shape[1]), np.float32)
        heads = np.searchsorted(inst, np.arange(n))
        some = np.diff(np.append(heads, len(inst))) > 0
        if some.any():
            x[some] = np.add.reduceat(self.emb[buckets] * weights[:, None].astype(np.float32), heads[some])
        g = softmax(x @ self.out + self.bias)
        g[np.arange(n), labels] -= 1
        back = (g @ self.out.T).astype(np.float32)
        self.out -= (rate / n) * (x.T @ g)
        self.bias -= (rate / n) * g.sum(0)
        order = np.argsort(buckets, kind="stable")
        sorted_buckets = buckets[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
        if len(sorted_buckets):
            moved = back[inst[order]] * weights[order, None].astype(np.float32)
            self.emb[sorted_buckets[heads]] -= rate * np.add.reduceat(moved, heads)

    def table(self) -> np.ndarray:
        """What each bucket adds to each class: the softmax of an average needs no more."""
        return self.emb @ self.out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def class_sample(rows: DataFrame, label: str, per_class: int) -> tuple[DataFrame, list]:
    """A repeatable sample of about ``per_class`` rows (and at most twice that) of each label,
    and the labels in order."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0), []
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(per_class / n)).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(chance < share).limit(2 * per_class * len(counts)), sorted(counts)


def trained(sample: DataFrame, fit) -> dict:
    """``fit`` (one Arrow table to arrays by name) run by one task over a bounded sample."""

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            made = fit(pa.Table.from_batches(found).combine_chunks().to_batches(max_chunksize=None)[0])
            found = None
            release()
            for name, value in made.items():
                value = np.asarray(value)
                row = [[name], [list(value.shape)], [value.astype(np.float32).tobytes()]]
                kinds = [pa.string(), pa.list_(pa.int64()), pa.binary()]
                yield pa.record_batch(
                    [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["name", "shape", "data"]
                )

    rows = sample.repartition(1).mapInArrow(run, "name string, shape array<long>, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in rows}
