"""Quality by a sparse ensemble of rules over statistics of a text.

Shallow boosted trees over the statistics of labelled texts give the rules: each path from
a root to a node is a conjunction of bounds on statistics. Logistic weights under an L1
penalty keep few of them. The rules that stay are compiled into one Spark column over the
statistics, so that a score is plain SQL arithmetic and can be read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.samples import labelled_sample
from scoutlake.llm.subwords import trained
from scoutlake.llm.words import LOWER, SPACE, Slice, arrow_map, crc_bucket, slices, span_hashes

SAMPLE = 4000  # labelled texts of each label
ROUNDS = 40  # trees
DEPTH = 3
CUTS = 32  # bounds tried per statistic
RATE = 0.3
SEED = 11
PENALTIES = np.geomspace(0.03, 0.0003, 9)  # of a weight, tried from strict to loose
GOOD = 0.7  # least score of a good text
PREFIX = "stat_"

STATS = (
    "words", "chars_a_word", "symbols", "marks", "stops", "upper", "digits", "wordless", "same_again", "distinct",
    "same_lines", "words_a_line", "longest",
)


def _bytes_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _bytes_of(b"#*$%&|<>~^=+_{}[]\\@/")
_MARKS = _bytes_of(b"!?")
_STOPS = _bytes_of(b".,;:")
_UPPER = _bytes_of(bytes(range(ord("A"), ord("Z") + 1)))
_DIGITS = _bytes_of(b"0123456789")
_LETTERS = _bytes_of(bytes([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC2, 0xF5)]))


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Distinct values in each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=groups)


def statistics(part: Slice) -> np.ndarray:
    """A row of ``STATS`` per text; ``part`` keeps the case of the texts. Shares of nothing are 0."""
    data, edges, n = part.data, part.byte_offsets, len(part)

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[edges])

    heads = ((data & 0xC0) != 0x80) & ~SPACE[data]
    lead = np.zeros(len(data), bool)  # capitals from U+00C0 on
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    chars, letters = count(heads), count(_LETTERS[data])
    words = np.diff(part.offsets)
    of_text = part.text_of_word()
    lowered = span_hashes(LOWER[data], part.starts, part.ends)
    again = np.zeros(len(lowered), bool)
    again[1:] = (lowered[1:] == lowered[:-1]) & (of_text[1:] == of_text[:-1])
    lettered = np.concatenate([[0], np.cumsum(_LETTERS[data])])
    wordless = lettered[part.ends] == lettered[part.starts]
    points = np.concatenate([[0], np.cumsum(heads)])
    width = points[part.ends] - points[part.starts]
    longest = np.zeros(n)
    some = np.flatnonzero(words)
    if len(some):
        longest[some] = np.maximum.reduceat(width, part.offsets[some])

    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(edges[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], edges[np.searchsorted(edges, starts, "right")])
    full = lettered[ends] > lettered[starts]
    starts, ends = starts[full], ends[full]
    line_text = np.searchsorted(edges, starts, "right") - 1
    lines = np.bincount(line_text, minlength=n)
    line_kinds = _distinct(line_text, span_hashes(data, starts, ends), n)

    def share(a, b):
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    out = np.stack(
        [
            np.log1p(words),
            share(chars, words),
            share(count(_SYMBOLS[data]), chars),
            share(count(_MARKS[data]), words),
            share(count(_STOPS[data]), words),
            share(count(_UPPER[data] | lead), letters),
            share(count(_DIGITS[data]), chars),
            share(np.bincount(of_text, wordless, n), words),
            share(np.bincount(of_text, again, n), words),
            share(_distinct(of_text, lowered, n), words),
            share(lines - line_kinds, lines),
            np.log1p(share(words, lines)),
            np.log1p(longest),
        ],
        axis=1,
    )
    return out.astype(np.float32).astype(np.float64)


def with_statistics(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but ``text``, and a column per statistic of the text (null: empty)."""
    kept = [c for c in rows.columns if c != "text"]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    names = [PREFIX + s for s in STATS]

    def make(batch):
        for part in slices(batch, lower=False):
            found = statistics(part)
            own = [batch.column(i).slice(part.row, len(part)) for i in range(len(kept))]
            yield pa.record_batch([*own, *[pa.array(found[:, i]) for i in range(len(STATS))]], names=[*kept, *names])

    told = rows.select(*[F.col(f"`{c}`") for c in kept], "text")
    return arrow_map(told, ", ".join([*kinds, *[f"{s} double" for s in names]]), make)


@dataclass
class Rules:
    """Conjunctions: rule r holds where low[r] < x <= high[r] in every statistic."""

    low: np.ndarray
    high: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.low)))
        for r in range(len(self.low)):
            out[:, r] = ((x > self.low[r]) & (x <= self.high[r])).all(1)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boosted_paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng) -> Rules:
    """Distinct paths of boosted trees over some of the rows and statistics each."""
    n, width = x.shape
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1]).astype(np.float32).astype(np.float64)) for j in range(width)]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)
    z, paths = np.zeros(n), {}

    def grow(rows, low, high, grads, curves, columns, depth):
        total_g, total_c = grads[rows].sum(), curves[rows].sum()
        value, best = total_g / (total_c + 1), None
        if depth < DEPTH:
            for j in columns:
                g = np.cumsum(np.bincount(binned[rows, j], grads[rows], len(bounds[j]) + 1))[:-1]
                c = np.cumsum(np.bincount(binned[rows, j], curves[rows], len(bounds[j]) + 1))[:-1]
                if len(g):
                    gain = g * g / (c + 1) + (total_g - g) ** 2 / (total_c - c + 1) - total_g * value
                    gain[(c < 1) | (total_c - c < 1)] = -1
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k)
        if best is None:
            z[_inside(x, low, high)] += RATE * value
            return
        _, j, k = best
        for side in (0, 1):
            a, b = low.copy(), high.copy()
            (b if side == 0 else a)[j] = bounds[j][k]
            paths[(*a, *b)] = None
            grow(rows[(binned[rows, j] <= k) == (side == 0)], a, b, grads, curves, columns, depth + 1)

    for _ in range(ROUNDS):
        p = _sigmoid(z)
        rows = np.flatnonzero(rng.random(n) < 0.6)
        columns = np.sort(rng.choice(width, max(2, width // 2), replace=False))
        grow(rows, np.full(width, -np.inf), np.full(width, np.inf), weight * (y - p), weight * p * (1 - p), columns, 0)
    found = np.array(list(paths)).reshape(-1, 2 * width)
    return Rules(found[:, :width], found[:, width:])


def _inside(x, low, high):
    return ((x > low) & (x <= high)).all(1)


def lasso(holds: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Weights of the rules, and the offset last, by accelerated proximal steps on the mean
    log loss with an L1 penalty on the weights."""
    a = np.column_stack([holds, np.ones(len(y))])
    w = weight / weight.sum()
    step = 4 / max(np.linalg.eigvalsh((a * w[:, None]).T @ a)[-1], 1e-9)
    now, ahead, t = start.copy(), start.copy(), 1.0
    limit = step * penalty * np.append(np.ones(holds.shape[1]), 0)
    for _ in range(600):
        moved = ahead - step * (a.T @ (w * (_sigmoid(a @ ahead) - y)))
        new = np.sign(moved) * np.maximum(np.abs(moved) - limit, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - now)
        if np.abs(new - now).max() < 1e-5:
            return new
        now = new
    return now


def _loss(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float(-(w * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / max(w.sum(), 1e-9))


def fit(shares: dict[int, float]):
    """Fitting from an Arrow batch of (label, statistics...); labels count by 1 / their share."""

    def run(batch: pa.RecordBatch) -> dict:
        y = batch.column(0).to_numpy().astype(float)
        x = np.stack([batch.column(i + 1).to_numpy() for i in range(len(STATS))], axis=1)
        order = np.lexsort((*x.T, y))  # the same rows in any order give the same rules
        x, y = x[order], y[order]
        weight = np.where(y == 1, 1 / shares.get(1, 1.0), 1 / shares.get(0, 1.0))
        rng = np.random.default_rng(SEED)
        rules = boosted_paths(x, y, weight / weight.mean(), rng)
        holds = rules(x)
        aside = rng.random(len(y)) < 0.25
        if not 0 < y[aside].sum() < aside.sum() or not 0 < y[~aside].sum() < (~aside).sum():
            aside[:] = False
        zero, losses = np.zeros(holds.shape[1] + 1), []
        if aside.any():
            w = zero
            for penalty in PENALTIES:
                w = lasso(holds[~aside], y[~aside], weight[~aside], penalty, w)
                losses.append(_loss(_sigmoid(holds[aside] @ w[:-1] + w[-1]), y[aside], weight[aside]))
            # the strictest penalty that is about as good as the best
            best = next(k for k, v in enumerate(losses) if v <= min(losses) * 1.02 + 1e-4)
        else:
            best = len(PENALTIES) // 2
        w = zero
        for penalty in PENALTIES[: best + 1]:
            w = lasso(holds, y, weight, penalty, w)
        kept = np.flatnonzero(np.abs(w[:-1]) > 1e-4)
        return {"low": rules.low[kept], "high": rules.high[kept], "weight": w[kept], "offset": [w[-1]]}

    return run


def compiled(model: dict) -> Column:
    """The score as a column over the statistics."""
    z = F.lit(float(model["offset"][0]))
    for low, high, weight in zip(model["low"], model["high"], model["weight"], strict=True):
        holds = F.lit(True)
        for name, a, b in zip(STATS, low, high, strict=True):
            stat = F.col(PREFIX + name)
            holds = holds & (stat > float(a)) if np.isfinite(a) else holds
            holds = holds & (stat <= float(b)) if np.isfinite(b) else holds
        z = z + F.when(holds, float(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def described(model: dict) -> list[tuple[str, float]]:
    """The rules as (conjunction, weight), strongest first."""
    out = []
    for low, high, weight in zip(model["low"], model["high"], model["weight"], strict=True):
        bounds = [f"{s} > {a:.4g}" for s, a in zip(STATS, low, strict=True) if np.isfinite(a)]
        bounds += [f"{s} <= {b:.4g}" for s, b in zip(STATS, high, strict=True) if np.isfinite(b)]
        out.append((" and ".join(bounds), float(weight)))
    return sorted(out, key=lambda r: -abs(r[1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> dict:
    """Model from the texts of ``docs`` that ``labels`` (doc_id, quality) rate."""
    sample, shares = labelled_sample(docs, labels, "quality", learn, SAMPLE)
    told = with_statistics(sample).select("label", *[PREFIX + s for s in STATS])
    model = trained(told, fit(shares)) if len(shares) == 2 else {}
    if not model:
        offset = 0.0 if not shares else 3.0 if 1 in shares else -3.0
        model = {"low": np.empty((0, len(STATS))), "high": np.empty((0, len(STATS))), "weight": np.empty(0), "offset": np.array([offset])}
    return model


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    ``labels`` has (doc_id, quality). ``learn`` is a condition on doc_id for the rows whose
    labels teach, by default crc32 of doc_id as text modulo 4 is not 2 (a null doc_id counts
    as empty text). Null texts are empty and scored like them; null labels and labels of null
    ids teach nothing; repeated rows are scored each; other columns are ignored. Without any
    label every score is 0.5, with one kind of label all are near it.
    """
    learn = learn if learn is not None else crc_bucket("doc_id", 4) != 2
    model = train(docs, labels, learn)
    told = with_statistics(docs.select("doc_id", (~learn).alias("held_out"), "text"))
    scored = told.select("doc_id", "held_out", compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
