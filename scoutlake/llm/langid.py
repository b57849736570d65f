"""Language identification: averaged hashed subword embeddings under a linear softmax.

The model learns from a bounded, documented sample of labelled texts, cut into segments
of some words; one task trains it. A fifth of the sampled texts is kept aside to fit the
temperature, and to tell texts of the languages from others: the mean log frequency of the
subwords of words without digits is compared between texts kept aside, with all languages, and the same
texts where their own language is left out, in turn. The score is the product of both
probabilities, that the text is of any language learnt and that it is of this one; below
a half it is rejected. Every whole text is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.subwords import Bags, Softmax, class_sample, softmax, subwords, text_sums, trained, word_sums
from scoutlake.llm.words import Slice, arrow_map, crc_bucket, slices

SAMPLE = 200  # texts per language
SIZES = (2, 3, 4)
BITS = 16
DIMS = 16
SEGMENT = 40  # words
SLICE = 1 << 19  # bytes of text handled at once, some hundred bytes of memory each
EPOCHS = 3
RATE = 4.0
SEED = 5
REJECT = 0.5  # least calibrated probability of an accepted text
KNOWN = 0.9  # share of texts of the languages among all, for the calibration
PIECES = (1, 4, 12, SEGMENT)  # words of the pieces that calibrate
SMOOTH = 0.01  # added to the count of each subword
ENOUGH = 20  # subwords whose mean counts half
STRAY = 0.02  # share of the pieces kept aside that may be no language at all
NONE = "und"
LETTER = regex.compile(r"\p{L}")


def _frequencies(bags: Bags, rows: np.ndarray, labels: np.ndarray, classes: int) -> np.ndarray:
    """Share of each bucket among the subwords of each language (languages x buckets)."""
    held = np.full((classes, 1 << BITS), SMOOTH)
    edges, buckets, counts = bags.edges, bags.buckets, bags.counts
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    of_class = np.full(len(edges) - 1, -1)
    of_class[rows] = labels
    taught = of_class[row] >= 0
    np.add.at(held, (of_class[row[taught]], buckets[taught]), counts[taught])
    return held / held.sum(1, keepdims=True)


def _plain(part: Slice) -> np.ndarray:
    """Words without a digit: numbers, keys and addresses are of no language."""
    digits = np.concatenate([[0], np.cumsum((part.data >= 0x30) & (part.data <= 0x39), dtype=np.int64)])
    return digits[part.ends] == digits[part.starts]


def _signs(mean: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the probability of a known language is a function of: short texts say little."""
    weight = counts / (counts + ENOUGH)
    return np.stack([np.ones(len(mean)), weight, weight * mean], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, slightly ridged."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step / max(1.0, np.abs(step).max() / 5)
    return w


def _novelty(frequencies: np.ndarray, parts: list[Slice], texts: np.ndarray, labels: np.ndarray):
    """Log frequency of each bucket in the languages together, and the logistic weights that tell
    pieces of known languages from others; ``texts`` marks those kept aside."""
    classes = len(frequencies)
    pooled = np.log(frequencies.mean(0))
    without = [np.log(np.delete(frequencies, c, 0).mean(0)) for c in range(classes)] if classes > 1 else []
    table = np.stack([pooled, *without], 1)
    inside, outside = [], []
    for part in parts:
        sums, counts = word_sums(part, table, SIZES, BITS)
        of_text = part.text_of_word()
        place = np.arange(len(of_text)) - part.offsets[of_text]
        kept = texts[of_text + part.row] & _plain(part)
        sums, counts, place, of_text = sums[kept], counts[kept], place[kept], of_text[kept]
        label = labels[of_text + part.row]
        for words in PIECES:
            piece = np.unique(of_text * (1 << 32) + place // words, return_inverse=True)[1]
            size = np.bincount(piece, counts)
            some = size > 0
            mean = np.bincount(piece, sums[:, 0])[some] / size[some]
            inside.append(_signs(mean, size[some])[mean >= np.quantile(mean, STRAY)] if some.any() else np.zeros((0, 3)))
            if without:
                left = np.bincount(piece, sums[np.arange(len(label)), 1 + label])[some] / size[some]
                outside.append(_signs(left, size[some]))
    # Letters at random, whose subwords fall anywhere.
    sizes = np.array([4.0, 20.0, 100.0, 1000.0])
    outside.append(_signs(np.full(len(sizes), pooled.mean()), sizes))
    inside, outside = np.concatenate([np.zeros((0, 3)), *inside]), np.concatenate(outside)
    if not len(inside):
        return pooled, np.array([30.0, 0.0, 0.0])  # nothing kept aside: all texts pass
    x = np.concatenate([inside, outside])
    y = np.repeat([1.0, 0.0], [len(inside), len(outside)])
    weight = np.where(y > 0, KNOWN / len(inside), (1 - KNOWN) / len(outside)) * len(x)
    return pooled, _logistic(x, y, weight)


def _fit(classes: int):
    def fit(batch):
        labels = batch.column(1).to_numpy()
        bags, of_segment = [], []
        for part in slices(batch, size=SLICE):
            place = np.arange(len(part.starts)) - np.repeat(part.offsets[:-1], np.diff(part.offsets))  # of a word in its text
            new = place % SEGMENT == 0
            segment = np.cumsum(new) - 1
            pieces = [(segment[w], b) for w, b in subwords(part, SIZES, BITS)]
            if pieces:
                bags.append(Bags.of(*map(np.concatenate, zip(*pieces, strict=True)), segment[-1] + 1, BITS))
                of_segment.append(part.text_of_word()[new] + part.row)
        if not bags:
            return {}  # no words
        bags, of_segment = Bags.joined(bags), np.concatenate(of_segment)
        aside = np.random.default_rng(SEED).random(len(labels)) < 0.2
        learn = np.flatnonzero(~aside[of_segment])
        model = Softmax(BITS, DIMS, classes, SEED)
        for e in range(EPOCHS):
            model.epoch(bags, learn, labels[of_segment[learn]], RATE * (1 - e / EPOCHS))
        table, bias = model.table(), model.bias
        logits, letters = [], []
        for part in slices(batch, size=SLICE):
            sums, counts = word_sums(part, table, SIZES, BITS)
            total = text_sums(counts, part)
            logits.append(text_sums(sums, part) / np.maximum(total, 1)[:, None] + bias)
            letters.append(total > 0)
        logits, used = np.concatenate(logits), aside & np.concatenate(letters)
        scales = np.geomspace(0.25, 64, 60)
        losses = [
            -np.log(np.maximum(softmax(s * logits[used])[np.arange(used.sum()), labels[used]], 1e-12)).mean() if used.any() else 0
            for s in scales
        ]
        frequencies = _frequencies(bags, learn, labels[of_segment[learn]], classes)
        pooled, known = _novelty(frequencies, list(slices(batch)), aside, labels)
        table = np.concatenate([table, pooled[:, None]], 1)
        return {"table": table, "bias": bias, "scale": [scales[int(np.argmin(losses))]], "known": known}

    return fit


def train(labelled: DataFrame) -> tuple[dict, list[str]]:
    """Model and languages from rows (doc_id, text, lang)."""
    sample, languages = class_sample(labelled, "lang", SAMPLE)
    code = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1 if languages else F.lit(0).cast("long")
    return trained(sample.select("text", code.alias("code")), _fit(len(languages))), languages


def identify(docs: DataFrame, learn=None) -> DataFrame:
    """(row, held_out, lang_pred, score, rejected) for each row of ``docs``, row being the
    row as a struct, so no column clashes.

    ``learn`` is a condition on the rows to learn from, by default crc32 of doc_id as text
    modulo 4 is not 2 (a null doc_id counts as empty text); of these only rows with text
    and lang teach. A null text, or one without a letter, is ``und`` with score 0 and
    rejected; so is every text when nothing can be learnt. ``rejected`` marks calibrated
    probabilities below ``REJECT``: texts of languages not learnt, random letters. Repeated rows are predicted each.
    """
    learn = learn if learn is not None else crc_bucket("doc_id", 4) != 2
    model, languages = train(docs.where(learn).where("text is not null and lang is not null").select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))
    rows = docs.select(F.struct("*").alias("row"), (~learn).alias("held_out"))

    def make(batch):
        now, names = shared.value
        found = batch.column(0)  # holds the texts, so that none is sent twice
        for part in slices(found, size=SLICE):
            texts = found.field("text").slice(part.row, len(part))
            lettered = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()])
            if now:
                sums, counts = word_sums(part, now["table"], SIZES, BITS)
                mean = text_sums(sums[:, :-1], part) / np.maximum(text_sums(counts, part), 1)[:, None]
                p = softmax(float(now["scale"][0]) * (mean + now["bias"]))
                plain = _plain(part)
                total = text_sums(counts * plain, part)
                usual = text_sums(sums[:, -1] * plain, part) / np.maximum(total, 1)
                known = 1 / (1 + np.exp(-np.clip(_signs(usual, total) @ now["known"], -30, 30)))
                best, score = p.argmax(1), p.max(1) * known
            else:
                best, score, lettered = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part), bool)
            yield pa.record_batch(
                [
                    found.slice(part.row, len(part)),
                    batch.column(1).slice(part.row, len(part)),
                    pa.array([names[b] if ok else NONE for b, ok in zip(best, lettered, strict=True)], pa.string()),
                    pa.array(np.where(lettered, score, 0.0)),
                    pa.array(~lettered | (score < REJECT)),
                ],
                names=["row", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return arrow_map(rows, f"row {kind}, held_out boolean, lang_pred string, score double, rejected boolean", make)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row of ``docs`` (doc_id, text, lang)."""
    found = identify(docs.select("doc_id", "text", "lang"))
    return found.select("row.doc_id", "held_out", "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that are not rejected."""
    return identify(docs).where("not rejected").select("row.*")
