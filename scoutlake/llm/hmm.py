"""Hidden Markov language model, trained by Baum-Welch counts added up across partitions.

Every training token counts. The most frequent tokens are symbols of their own; the others
share classes by their last bytes, and inside a class a token has its add-0.1 share of the
class. So the state tables stay bounded while the vocabulary grows with the corpus:

    P(text) = sum over state paths of prod P(state' | state) P(symbol | state') * P(token | symbol)

The first factor comes from the scaled forward recursion, the second from the counts. Both
sum to one over all texts that the vocabulary and one unknown token per class can form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.words import Lookup, arrow_map, crc_bucket, frequent, mixed, slices
from scoutlake.session import stage

STATES = 8
ROUNDS = 4
SYMBOLS = 4096  # tokens with a symbol of their own
CLASSES = 512  # symbols that the other tokens share
KNOWN = 1 << 18  # at most so many frequent tokens, whose counts every task holds
ADD = 0.1
PRIOR = 20.0  # pseudo-count of the corpus distribution in each state
SEED = 11
END = np.uint64(0xE0F1A2B3C4D5E6F7)  # the end token's hash
CHUNK = 1_000_000  # tokens handled at once
SEGMENT = 512  # tokens; for the counts, a longer text is several sequences


def _tokens(part):
    """(hash, class) of the words of a slice."""
    h = part.hashes()
    tail = np.zeros(len(h), np.uint64)
    for k in (3, 2, 1):
        at = part.ends - k
        tail = tail * np.uint64(256) + np.where(at >= part.starts, part.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return h, (mixed(tail) % np.uint64(CLASSES)).astype(np.int64)


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, cls, c): how often each training token occurs; the end token has class -1."""

    def make(batch):
        for part in slices(batch):
            h, cls = _tokens(part)
            order = np.argsort(h)
            h, cls = h[order], cls[order]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
            yield pa.record_batch(
                [
                    pa.array(np.append(h[heads], END).view(np.int64)),
                    pa.array(np.append(cls[heads], -1).astype(np.int32)),
                    pa.array(np.append(np.diff(np.append(heads, len(h))), len(part)).astype(np.int64)),
                ],
                names=["h", "cls", "c"],
            )

    counted = arrow_map(docs.where("not held_out").select("text"), "h long, cls int, c long", make)
    return stage(counted.groupBy("h", "cls").agg(F.sum("c").alias("c")), "tokens")


class Vocabulary:
    """The frequent tokens: hashes in order, their counts and symbols."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        by_hash = np.argsort(h)
        self.lookup = Lookup(h[by_hash])
        rank = np.arange(len(h))  # the end first, then by falling count
        own = np.where(rank < SYMBOLS, rank, -1)
        self.count = np.append(c[by_hash], 0)
        self.symbol = np.append(own[by_hash], -1)


def sequences(docs: DataFrame, vocabulary, total: int, distinct: int) -> DataFrame:
    """One row per document: what the frequent tokens give to the scores, the hashes of the
    others, and the symbols as two bytes each. Staged, as every round reads the symbols."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    scale = np.log10(total + ADD * (distinct + 1))

    def make(batch):
        words = known.value
        end = words.lookup(np.array([END]))[0]
        end_count, end_symbol = words.count[end], words.symbol[end]
        if end_symbol < 0:
            end_symbol = SYMBOLS + CLASSES
        for part in slices(batch):
            h, cls = _tokens(part)
            at = words.lookup(h)
            symbol = words.symbol[at]
            symbol = np.where(symbol >= 0, symbol, SYMBOLS + cls)
            logs = np.where(at >= 0, np.log10(words.count[at] + ADD) - scale, 0.0)
            n = np.diff(part.offsets)
            sums = np.concatenate([[0.0], np.cumsum(logs)])[part.offsets]
            counted = np.concatenate([[0], np.cumsum(at >= 0)])[part.offsets]
            # Frequent tokens without a symbol of their own owe their share of the class.
            shared = (at >= 0) & (words.symbol[at] < 0)
            other = at < 0
            ends = np.insert(symbol, part.offsets[1:], end_symbol).astype("<u2")
            cuts = part.offsets + np.arange(len(n) + 1)
            data = [ends[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

            def lists(mask, values):
                offsets = np.concatenate([[0], np.cumsum(mask)])[part.offsets].astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[mask]))

            yield pa.record_batch(
                [
                    batch.column(0).slice(part.row, len(part)).cast(pa.int64()),
                    batch.column(1).slice(part.row, len(part)),
                    pa.array(n + 1, pa.int64()),
                    pa.array(counted[1:] - counted[:-1] + (end_count > 0), pa.int64()),
                    pa.array(sums[1:] - sums[:-1] + np.log10(end_count + ADD) - scale),
                    lists(other, h.view(np.int64)),
                    lists(other, cls.astype(np.int32)),
                    pa.array(_shares(words.count[at], cls, shared, part.offsets)),
                    _class_counts(cls, shared, part.offsets),
                    pa.array(data, pa.binary()),
                ],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "rare", "rare_cls", "shares", "owed", "symbols"],
            )

    kinds = (
        "doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, "
        "rare_cls array<int>, shares double, owed array<int>, symbols binary"
    )
    made = arrow_map(docs.select("doc_id", "held_out", "text"), kinds, make)
    return stage(made.withColumn("rid", F.monotonically_increasing_id()), "sequences")


def _shares(counts, cls, shared, offsets) -> np.ndarray:
    logs = np.where(shared, np.log10(counts + ADD), 0.0)
    sums = np.concatenate([[0.0], np.cumsum(logs)])[offsets]
    return sums[1:] - sums[:-1]


def _class_counts(cls, shared, offsets) -> pa.ListArray:
    """Classes of the frequent tokens without a symbol, per text."""
    at = np.concatenate([[0], np.cumsum(shared)])[offsets].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(cls[shared].astype(np.int32)))


def _chunks(symbols: list[bytes]):
    """Positions of texts of like length, and their symbols one step of all texts after another."""
    lengths = np.array([len(s) // 2 for s in symbols])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, int(np.searchsorted(np.cumsum(lengths[order[at:]]), CHUNK)))
        rows = order[at:to]
        n = lengths[rows]
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts longer than each step
        steps = np.concatenate([[0], np.cumsum(active)])
        packed = np.empty(steps[-1], np.int64)
        for k, row in enumerate(rows):
            packed[steps[: n[k]] + k] = np.frombuffer(symbols[row], "<u2")
        yield rows, packed, active, steps
        at = to


def forward(model, packed, active, steps, out=None):
    """Scaled forward recursion: log10 likelihood of each text. ``out`` (vectors, scales)
    takes what the backward recursion needs."""
    start, move, emit = model
    logs = np.zeros(active[0])
    ones = np.ones(len(start), emit.dtype)
    alpha = np.broadcast_to(start, (active[0], len(start)))
    for t, n in enumerate(active):
        a, b = steps[t], steps[t + 1]
        alpha = (alpha[:n] @ move if t else alpha) * emit[packed[a:b]]
        scale = alpha @ ones
        alpha /= scale[:, None]
        if out is None:
            logs[:n] += np.log10(scale)
        else:
            out[0][a:b], out[1][a:b] = alpha, scale
    return logs


def expected_counts(model, symbols: list[bytes], size: int):
    """Baum-Welch counts of some texts: starts, moves, emissions, log10 likelihood.

    Texts are cut into segments, each a sequence of its own, so that few steps serve many
    texts at once; only a text's first segment counts as a start. Scores are of whole texts,
    never of segments.
    """
    begins = np.array([a == 0 for s in symbols for a in range(0, len(s), 2 * SEGMENT)])  # only these tell starts
    symbols = [s[a : a + 2 * SEGMENT] for s in symbols for a in range(0, len(s), 2 * SEGMENT)]
    model = tuple(x.astype(np.float32) for x in model)  # counts need no more digits
    start, move, emit = model
    k = len(start)
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, size)), 0.0
    room = (np.empty((0, k), np.float32), np.empty(0, np.float32))
    for rows, packed, active, steps in _chunks(symbols):
        if len(packed) > len(room[1]):
            room = (np.empty((len(packed), k), np.float32), np.empty(len(packed), np.float32))
        alphas, scales = room
        forward(model, packed, active, steps, room)
        total += np.log10(scales[: len(packed)], dtype=np.float64).sum()
        ahead = np.ones((0, k), np.float32)  # what a step sees of the one after it
        for t in range(len(active) - 1, -1, -1):
            a, b = steps[t], steps[t + 1]
            m = len(ahead)
            back = np.ones((b - a, k), np.float32)
            if m:
                moves += alphas[a : a + m].T @ ahead
                np.matmul(ahead, move.T, out=back[:m])
            alphas[a:b] *= back
            back *= emit[packed[a:b]]
            back /= scales[a:b, None]
            ahead = back
        starts += alphas[: active[0]][begins[rows]].sum(0, dtype=np.float64)
        for a in range(0, len(packed), 1 << 16):
            seen, weights = packed[a : a + (1 << 16)], np.ascontiguousarray(alphas[a : min(a + (1 << 16), len(packed))].T)
            for s in range(k):
                emissions[s] += np.bincount(seen, weights[s], size)
    return starts, moves * move, emissions.T, total


def _estimate(starts, moves, emissions, unigram):
    start = (starts + 1) / (starts + 1).sum()
    move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
    emit = emissions + PRIOR * unigram[:, None]
    return start, move, emit / emit.sum(0)


def first_model(unigram: np.ndarray):
    """Sticky states whose emissions are the corpus distribution under seeded noise."""
    noise = np.random.default_rng(SEED).normal(0, 1, (len(unigram), STATES))
    emit = unigram[:, None] * np.exp(noise)
    move = np.full((STATES, STATES), 0.2 / (STATES - 1))
    np.fill_diagonal(move, 0.8)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(0)


def train(texts: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS):
    """Baum-Welch over the symbols of ``texts``: each batch of texts adds up its expected
    counts, the shuffle adds up the batches, and the tables of bounded size are estimated."""
    spark = texts.sparkSession
    size = len(unigram)
    model = first_model(unigram)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            now = shared.value
            sums = None
            for batch in batches:
                if batch.num_rows:
                    got = expected_counts(now, batch.column(0).to_pylist(), size)
                    sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
            if sums is not None:
                flat = np.concatenate([sums[0], sums[1].ravel(), sums[2].ravel(), [sums[3]]])
                some = np.flatnonzero(flat)
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array(flat[some])], names=["cell", "v"])

        cells = texts.select("symbols").mapInArrow(run, "cell int, v double")
        got = cells.groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(STATES + STATES**2 + size * STATES + 1)
        flat[got["cell"].to_numpy()] = got["v"].to_numpy()
        starts, moves = flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES)
        model = _estimate(starts, moves, flat[STATES + STATES**2 : -1].reshape(size, STATES), unigram)
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, held_out=None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of
    ``docs`` (doc_id, text).

    ``held_out`` is a condition on the rows that teach nothing; by default crc32 of doc_id
    as text, modulo 10, is 0 (a null doc_id counts as empty text). Tokens are the
    lower-cased (A-Z) words and one end; a null or empty text is the end alone. Repeated
    rows are scored and counted each. With no training row at all, every token is unknown:
    base and score are both the uniform choice of one token (0). Other columns are ignored.
    """
    held = held_out if held_out is not None else crc_bucket("doc_id", 10) == 0
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    counts = token_counts(docs)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole["n"], whole["v"]
    end = F.col("h") == int(END.view(np.int64))
    top = frequent(counts.where(~end), "c", KNOWN).toPandas().sort_values(["c", "h"], ascending=[False, True])
    top = pd.concat([counts.where(end).toPandas(), top], ignore_index=True)  # the end always has its count and symbol
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    vocabulary = Vocabulary(h, top["c"].to_numpy(np.int64))
    own = top.head(SYMBOLS)
    per_class = (
        counts.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in own["h"]], "h long")), "h", "left_anti")
        .groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    ).toPandas()
    mass = np.full(CLASSES, ADD)
    inside = per_class["cls"] >= 0
    mass[per_class["cls"][inside]] += per_class["c"][inside] + ADD * per_class["v"][inside]
    unigram = np.concatenate([np.zeros(SYMBOLS), mass, [ADD]])
    unigram[: len(own)] = own["c"].to_numpy(float) + ADD
    unigram = (unigram + 1e-9) / (unigram + 1e-9).sum()

    rows = sequences(docs, vocabulary, total, distinct)
    model = train(rows.where("not held_out"), unigram, rounds)
    log_mass = np.log10(mass)
    shared = docs.sparkSession.sparkContext.broadcast((model, log_mass))

    def likelihood(batch):
        now, logs = shared.value
        symbols = batch.column(4).to_pylist()
        out = np.zeros(len(symbols))
        for at, packed, active, steps in _chunks(symbols):
            out[at] = forward(now, packed, active, steps)
        owed = batch.column(6)
        for column in (batch.column(5), owed):  # both kinds of class members pay for their class
            flat = np.append(logs[column.flatten().to_numpy()].cumsum(), 0.0)
            edges = column.offsets.to_numpy() - column.offsets[0].as_py()
            out -= np.where(edges[1:] > 0, flat[edges[1:] - 1], 0) - np.where(edges[:-1] > 0, flat[edges[:-1] - 1], 0)
        yield pa.record_batch(
            [*(batch.column(k) for k in range(4)), pa.array(out), batch.column(7)],
            names=["rid", "n_tokens", "known", "base", "hidden", "shares"],
        )

    hidden = arrow_map(
        rows.select("rid", "n_tokens", "known", "base", "symbols", "rare_cls", "owed", "shares"),
        "rid long, n_tokens long, known long, base double, hidden double, shares double",
        likelihood,
    )
    scale = float(np.log10(total + ADD * (distinct + 1)))
    rare = (
        rows.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("times"))
        .join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("rid").agg(
            F.sum(F.col("times") * F.log10(F.col("c") + ADD)).alias("logs"),
            F.sum("times").alias("times"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    logs, times = F.coalesce("logs", F.lit(0.0)), F.coalesce("times", F.lit(0))
    return (
        rows.select("rid", "doc_id", "held_out").join(hidden, "rid").join(rare, "rid", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + logs - times * F.lit(scale)).alias("base_score"),
            (F.col("hidden") + F.col("shares") + logs).alias("score"),
        )
    )
