"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. In every group of language and
source the minimum-covariance-determinant estimate is sought: the ``SHARE`` of rows whose
covariance has the least determinant, by concentration steps (take the rows nearest to the
estimate, estimate again) from two starts over all rows, made consistent for the share that
it rests on. A document is rejected where its Mahalanobis distance from that estimate is
above the limit. All steps are aggregates by
group over the staged vectors: no group is ever collected, whatever its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.llm.words import SPACE, Slice, arrow_map, mixed, slices, span_hashes
from scoutlake.session import small_table, stage

SHARE = 0.75
STEPS = 3
LIMIT = 20.515  # squared distance: the 0.999 quantile of chi-square in 5 dimensions
LEAST_ROWS = 30  # smaller groups are judged as part of all rows of their language, then of all
BINS_PER_E = 32  # of the logarithm of the squared distance
VECTOR = ("log_words", "log_width", "symbols", "dup_lines", "repeats")
# Added in quadrature to every deviation so that covariances can be inverted.
FLOOR = (0.01,) * 5
# Least standard deviation in the estimate itself, for statistics that hardly vary in a group:
# a twentieth of the words, a fiftieth of the width, two symbols per 100 characters, two
# repeated lines, or one repeated window in a text of 50 words reject nobody by themselves.
LEAST = (0.05, 0.02, 0.25, 0.25, 0.6)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def counts(part: Slice) -> dict[str, np.ndarray]:
    """Base statistics of each text of a slice."""
    inside = ~SPACE[part.data]

    def per_text(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[part.byte_offsets])

    chars = per_text(inside & ((part.data & 0xC0) != 0x80))
    return {
        "n_words": np.diff(part.offsets),
        "word_chars": chars,
        "n_symbols": per_text(SYMBOL[part.data]),
        "n_dup_lines": _dup_lines(part),
        "n_repeat_words": _repeat_words(part),
    }


def _dup_lines(part: Slice) -> np.ndarray:
    breaks = np.flatnonzero(part.data == 0x0A)
    starts = np.union1d(part.byte_offsets[:-1], breaks + 1)
    starts = starts[starts < len(part.data)]
    if not len(starts):
        return np.zeros(len(part), np.int64)
    ends = np.append(starts[1:], len(part.data))
    ends = ends - (part.data[ends - 1] == 0x0A)  # the break is not part of its line
    worded = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(part.byte_offsets, starts, "right") - 1
    again = _seen_before(_keyed(span_hashes(part.data, starts, ends), text))
    return np.bincount(text[again], minlength=len(part))


def _repeat_words(part: Slice) -> np.ndarray:
    h = part.hashes()
    text = part.text_of_word()
    if len(h) < 3:
        return np.zeros(len(part), np.int64)
    one = np.uint64(3)
    windows = mixed(mixed(mixed(h[:-2] * one + np.uint64(1)) + h[1:-1]) + h[2:])
    at = np.flatnonzero(text[:-2] == text[2:])
    keys = _keyed(windows[at], text[at])
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 3, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    return np.bincount(text[np.cumsum(cover)[: len(h)] > 0], minlength=len(part))


def _keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mixed(h ^ mixed(text.astype(np.uint64) + np.uint64(1)))


def _seen_before(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    rows = docs.select("doc_id", "lang", "source", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make(batch):
        for part in slices(batch, lower=False):
            got = counts(part)
            yield pa.record_batch(
                [
                    *(batch.column(k).slice(part.row, len(part)) for k in range(3)),
                    *(pa.array(got[n].astype(np.int64)) for n in names),
                ],
                names=["doc_id", "lang", "source", *names],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return arrow_map(rows, fields + "".join(f", {n} long" for n in names), make)


def _vector(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "log_words": F.log(n),
            "log_width": F.log(chars / n),
            "symbols": F.log1p(100 * F.col("n_symbols") / chars),
            "dup_lines": F.log1p("n_dup_lines"),
            "repeats": F.log1p(100 * F.col("n_repeat_words") / n),
        }
    )


def _moments(df: DataFrame) -> DataFrame:
    """Per group: number, means, and the inverse and determinant of the covariance."""
    p = len(VECTOR)
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(VECTOR)]
    cross = [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]

    def invert(frame):
        for batch in frame:
            t = batch.to_pydict()
            n = batch.num_rows
            c = np.empty((n, p, p))
            for i in range(p):
                for j in range(i, p):
                    c[:, i, j] = c[:, j, i] = t[f"c{i}{j}"]
            c[:, range(p), range(p)] += np.square(FLOOR)
            means = np.array([t[f"m{i}"] for i in range(p)]).T
            yield pa.record_batch(
                [
                    pa.array(t["grp"], pa.string()),
                    pa.array(t["n"], pa.int64()),
                    pa.array(means.tolist(), pa.list_(pa.float64())),
                    pa.array(np.linalg.inv(c).reshape(n, -1).tolist() if n else [], pa.list_(pa.float64())),
                    pa.array(np.linalg.slogdet(c)[1] if n else [], pa.float64()),
                ],
                names=["grp", "rows", "mean", "inv", "logdet"],
            )

    got = df.groupBy("grp").agg(F.count("*").alias("n"), *sums, *cross)
    return got.mapInArrow(invert, "grp string, rows long, mean array<double>, inv array<double>, logdet double")


def _distance(df: DataFrame, estimate: DataFrame) -> DataFrame:
    """``df`` with the squared distance ``d2`` from its group's estimate."""
    p = len(VECTOR)
    joined = df.join(small_table(estimate), "grp")
    gap = [F.col(c) - F.get("mean", F.lit(i)) for i, c in enumerate(VECTOR)]
    d2 = sum(gap[i] * gap[j] * F.get("inv", F.lit(i * p + j)) for i in range(p) for j in range(p))
    return joined.withColumn("d2", d2)


def _nearest(df: DataFrame, estimate: DataFrame) -> DataFrame:
    """The rows nearest to the estimate: all bins of distance up to the one where the share
    is reached, so equal rows are in or out together."""
    far = _distance(df, estimate).drop("mean", "inv", "logdet", "rows")
    binned = far.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS_PER_E))
    per_bin = binned.groupBy("grp", "bin").count()
    total = per_bin.groupBy("grp").agg(F.sum("count").alias("total"))
    below = F.expr("sum(count) over (partition by grp order by bin)")  # bins are a few hundred
    last = (
        per_bin.withColumn("below", below).join(total, "grp").where(F.col("below") >= SHARE * F.col("total"))
        .groupBy("grp").agg(F.min("bin").alias("last"))
    )
    return binned.join(small_table(last), "grp").where("bin <= last").drop("bin", "last", "d2")


def _median_start(df: DataFrame) -> DataFrame:
    """Estimate from the rows near the medians: within two deviations of each statistic."""
    middle = df.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"q{i}") for i, c in enumerate(VECTOR)])
    joined = df.join(small_table(middle), "grp")
    apart = joined.groupBy("grp").agg(
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"q{i}")), 0.5, 1000).alias(f"a{i}") for i, c in enumerate(VECTOR)]
    )
    joined = joined.join(small_table(apart), "grp")
    near = F.lit(True)
    for i, c in enumerate(VECTOR):
        near = near & (F.abs(F.col(c) - F.col(f"q{i}")) <= 3 * F.col(f"a{i}") + LEAST[i])
    return _moments(joined.where(near).select("grp", *VECTOR))


def _chi_square(x: float, p: int) -> float:
    """Probability of at most ``x`` in ``p`` dimensions."""
    got = math.erf(math.sqrt(x / 2)) if p % 2 else -math.expm1(-x / 2)
    for k in range(2 - p % 2, p, 2):
        got -= math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x else 0.0
    return got


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows is too small by."""
    if not p or share >= 1:
        return 1.0
    low, high = 0.0, 200.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, p) < share else (low, mid)
    return share / _chi_square(high, p + 2)


def _consistent(best: DataFrame) -> DataFrame:
    """``best`` with the inverse of the covariance scaled by ``consistency`` over the statistics
    that vary, and with the least deviations where one does not."""
    p = len(VECTOR)

    def scale(frame):
        for batch in frame:
            inv = []
            for got, rows, total in zip(*(batch.column(n).to_pylist() for n in ("inv", "rows", "total")), strict=True):
                c = np.linalg.inv(np.array(got).reshape(p, p))
                c *= consistency(rows / total, int((c.diagonal() > np.square(LEAST)).sum()))
                c[range(p), range(p)] += np.maximum(np.square(LEAST) - c.diagonal(), 0)
                inv.append(np.linalg.inv(c).reshape(-1).tolist())
            names = ["grp", "rows", "mean", "inv", "logdet"]
            columns = {n: batch.column(n) for n in names} | {"inv": pa.array(inv, pa.list_(pa.float64()))}
            yield pa.record_batch([columns[n] for n in names], names=names)

    return best.mapInArrow(scale, "grp string, rows long, mean array<double>, inv array<double>, logdet double")


def estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """(grp, rows, mean, inv, logdet): the better of two concentrated estimates per group."""
    ends = []
    for start in (_moments(vectors), _median_start(vectors)):
        now = start
        for _ in range(steps):
            now = _moments(_nearest(vectors, now))
        ends.append(now)
    both = ends[0].unionByName(ends[1])
    best = F.min_by(F.struct("rows", "mean", "inv", "logdet"), F.struct("logdet", "rows")).alias("e")
    totals = vectors.groupBy("grp").agg(F.count("*").alias("total"))
    return _consistent(both.groupBy("grp").agg(best).select("grp", "e.*").join(small_table(totals), "grp"))


def _groups(rows: DataFrame) -> DataFrame:
    """(own, grp, fits) per language and source of ``rows``: whose estimate judges a group, and
    which estimates it shapes."""
    sizes = rows.groupBy("own", "wide").count()
    of_lang = Window.partitionBy("wide")
    least = F.lit(LEAST_ROWS)
    grp = (
        F.when(F.col("count") >= least, F.col("own"))
        .when(F.sum("count").over(of_lang) >= least, F.col("wide"))
        .otherwise("all")
    )
    told = stage(sizes.withColumn("grp", grp), "groups")
    serving = told.select(F.col("grp").alias("fit")).distinct()
    fits = told.select("own", F.explode(F.array("own", "wide", F.lit("all"))).alias("fit")).join(small_table(serving), "fit")
    return told.select("own", "grp").join(fits.groupBy("own").agg(F.collect_set("fit").alias("fits")), "own")


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance, kept) for every row of ``docs`` (doc_id, text, lang, source).

    A text fails the base rules with fewer than 50 words or more than half of its words in
    repeated three-word windows; null and empty texts do. Failed rows shape no estimate and
    have a null distance. A null language or source is a group of its own; a group of fewer
    than ``LEAST_ROWS`` rows is judged by the estimate over all rows of its language, and where
    these are too few, over all rows. Repeated rows count each. Other columns are ignored.
    """
    base = stage(
        statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))),
        "statistics",
    )
    named = base.where("not base_failed").withColumns(
        {"own": F.to_json(F.struct("lang", "source")), "wide": F.concat(F.lit("lang "), F.to_json(F.struct("lang")))}
    )
    groups = stage(_groups(named), "levels")
    fit = _vector(named).join(small_table(groups.select("own", "fits")), "own").withColumn("grp", F.explode("fits"))
    vectors = stage(fit.select("grp", *VECTOR), "vectors")
    told = _distance(_vector(named).join(small_table(groups.select("own", "grp")), "own"), estimates(vectors))
    out = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    passed = told.select(*out, F.sqrt("d2").alias("distance"), (F.col("d2") <= limit).alias("kept"))
    failed = base.where("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.unionByName(failed)
