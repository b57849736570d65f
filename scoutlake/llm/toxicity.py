"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

Subwords are averaged over short windows of words, and a text is as toxic as its worst
window, so one insult counts alike in a short and in a very long text. The model learns
from a bounded, documented sample of labelled texts: windows of clean texts are clean; of
a toxic text only the windows that the model itself finds worst are taken for toxic, first
by the odds of their subwords. A fifth of the texts is kept aside for the calibration.
Misspelt words share most of their subwords with the words they stand for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scoutlake.llm.samples import labelled_sample
from scoutlake.llm.subwords import Bags, Softmax, subwords, trained, word_sums
from scoutlake.llm.words import Slice, arrow_map, crc_bucket, slices

SAMPLE = 600  # texts per label
SIZES = (3, 4, 5)
BITS = 18
DIMS = 8
WINDOW = 2  # words
TOXIC_WINDOWS = 3  # of a toxic text, taken for toxic
CLEAN_WINDOWS = 12  # of a clean text: the worst half of them, the rest at random
ROUNDS = 4
RATE = 2.0
SEED = 7


def worst(part: Slice, table: np.ndarray) -> np.ndarray:
    """Highest window value of each text, 0 for texts without words. Windows begin anew with
    each text: its first words make shorter ones."""
    sums, counts = word_sums(part, table[:, None], SIZES, BITS)
    out = np.zeros(len(part))
    some = np.flatnonzero(np.diff(part.offsets))
    if len(some):
        values = _within(sums[:, 0], counts, part.offsets)
        out[some] = np.maximum.reduceat(values, part.offsets[some])
    return out


def _within(sums, counts, offsets) -> np.ndarray:
    """Window means that do not reach into the text before."""
    place = np.arange(len(sums)) - np.repeat(offsets[:-1], np.diff(offsets))
    total, number = sums.copy(), counts.copy()
    for k in range(1, WINDOW):
        reach = place >= k
        at = np.flatnonzero(reach)
        total[at] += sums[at - k]
        number[at] += counts[at - k]
    return total / np.maximum(number, 1)


def fit(batch: pa.RecordBatch) -> dict:
    """Model from a table of (text, toxic 0 or 1), in an order of its own."""
    batch = batch.take(pc.sort_indices(pa.table(batch), [(batch.schema.names[0], "ascending"), (batch.schema.names[1], "ascending")]))
    labels = batch.column(1).to_numpy()
    parts = list(slices(batch))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.offsets) for p in parts]))])
    n_words = offsets[-1]
    of_text = np.repeat(np.arange(len(labels)), np.diff(offsets))
    words, buckets, seen = [], [], 0
    for p in parts:
        for w, b in subwords(p, SIZES, BITS):
            words.append((w + seen).astype(np.int32))
            buckets.append(b.astype(np.int32))
        seen += len(p.starts)
    if not seen:
        return {"table": np.zeros(1 << BITS), "line": [0.0, -4.0]}
    words, buckets = np.concatenate(words), np.concatenate(buckets)
    bags = Bags.of(words, buckets, n_words, BITS)
    sizes = np.diff(bags.edges)
    in_word = np.repeat(np.arange(n_words), sizes)
    rng = np.random.default_rng(SEED)
    aside = rng.random(len(labels)) < 0.2

    # Odds of a subword: in how many texts of each label it occurs.
    text_bag = Bags.of(of_text[words], buckets, len(labels), BITS)
    owner = np.repeat(np.arange(len(labels)), np.diff(text_bag.edges))
    ratio = np.zeros(1 << BITS)
    for label, sign in ((1, 1), (0, -1)):
        use = ~aside[owner] & (labels[owner] == label)
        df = np.bincount(text_bag.buckets[use], minlength=1 << BITS)
        ratio += sign * np.log((df + 0.5) / (max((~aside & (labels == label)).sum(), 1) + 1))

    def values(table):
        sums = np.bincount(in_word, table[bags.buckets] * bags.counts, n_words)
        counts = np.bincount(in_word, bags.counts, n_words)
        return _within(sums, counts, offsets)

    model = Softmax(BITS, DIMS, 2, SEED)
    score = values(ratio)
    for turn in range(ROUNDS):
        picked, told = [], []
        for t in np.flatnonzero(~aside):
            a, b = offsets[t], offsets[t + 1]
            if a == b:
                continue
            order = np.argsort(-score[a:b])
            if labels[t] == 1:
                best = order[:TOXIC_WINDOWS]
                rows = best[score[a + best] > 0.5 * score[a + order[0]]] if score[a + order[0]] > 0 else best[:1]
            else:
                rows = np.concatenate([order[: CLEAN_WINDOWS // 2], rng.integers(0, b - a, CLEAN_WINDOWS // 2)])
            picked.append(a + rows)
            told.append(np.full(len(rows), labels[t]))
        picked, told = np.concatenate(picked), np.concatenate(told)
        windows = _windows(bags, picked, offsets, of_text)
        for _ in range(2):
            model.epoch(windows, np.arange(len(picked)), told, RATE * (1 - turn / ROUNDS), 32)
        table = model.table()
        table = table[:, 1] - table[:, 0]
        score = values(table)
    top = np.zeros(len(labels))
    some = np.flatnonzero(np.diff(offsets))
    top[some] = np.maximum.reduceat(score, offsets[some])
    return {"table": table, "line": _platt(top[aside], labels[aside])}


def _windows(bags: Bags, picked: np.ndarray, offsets: np.ndarray, of_text: np.ndarray) -> Bags:
    """Bags of the windows that end at the picked words."""
    inst, buckets, counts = [], [], []
    for k in range(WINDOW):
        word = picked - k
        use = np.flatnonzero(word >= offsets[of_text[picked]])
        sizes = bags.edges[word[use] + 1] - bags.edges[word[use]]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bags.edges[word[use]] - (ends - sizes), sizes)
        inst.append(np.repeat(use, sizes))
        buckets.append(bags.buckets[at])
        counts.append(bags.counts[at])
    inst, buckets, counts = map(np.concatenate, (inst, buckets, counts))
    order = np.argsort(inst, kind="stable")
    inst = inst[order]
    return Bags(np.searchsorted(inst, np.arange(len(picked) + 1)), buckets[order], counts[order])


def _platt(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Slope and offset of the logistic curve of the label over the worst window."""
    if not len(x) or y.min() == y.max():
        return [1.0, -4.0]
    mean, spread = x.mean(), x.std() + 1e-9
    z, a, b = (x - mean) / spread, 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):  # Newton steps on the log loss, damped by a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - target) * z).sum() + 0.1 * a, (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return [a / spread, b - a * mean / spread]


def score_documents(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    ``labels`` has (doc_id, toxic). ``learn`` is a condition on doc_id for the rows whose
    labels teach, by default crc32 of doc_id as text modulo 5 is not 0 (a null doc_id
    counts as empty text). Null texts are empty; an empty text has the score of a worst
    window of 0, like one of unknown subwords only, which lies above that of texts known to
    be clean. Null labels and labels of null ids are passed over; repeated rows are scored
    each, and teach once. Without a label of either kind every score is the same, below
    0.5. Other columns are ignored.
    """
    learn = learn if learn is not None else crc_bucket("doc_id", 5) != 0
    sample, shares = labelled_sample(docs, labels, "toxic", learn, SAMPLE)
    model = trained(sample, fit) if len(shares) == 2 else {}
    model = model or {"table": np.zeros(1 << BITS, np.float32), "line": np.array([1.0, -4.0])}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        now = shared.value
        slope, offset = map(float, now["line"])
        for part in slices(batch):
            z = np.clip(slope * worst(part, now["table"]) + offset, -30, 30)
            score = 1 / (1 + np.exp(-z))
            yield pa.record_batch(
                [
                    batch.column(0).slice(part.row, len(part)),
                    batch.column(1).slice(part.row, len(part)),
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    told = docs.select("doc_id", (~learn).alias("held_out"), "text")
    kind = told.schema["doc_id"].dataType.simpleString()
    return arrow_map(told, f"doc_id {kind}, held_out boolean, score double, predicted int", make)
