"""p-values as vectorised helpers. Inputs are test statistics: a handful of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square variable, by the finite sums for integer ``df``."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, acc = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            acc += term
        return math.exp(-half) * acc
    acc = math.erfc(math.sqrt(half))
    term = math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        acc += term
        term *= half / (i + 1.5)
    return acc


def signed_rank_tail(ranks: list[float], w: float) -> float:
    """Two-sided p of the Wilcoxon statistic ``w`` = min(W+, W-): the exact distribution over
    all sign patterns, for any number of ranks; tied (half) ranks count doubled."""
    if not ranks:
        return 1.0
    chance = np.ones(1)
    for r in sorted(ranks):
        step = round(2 * r)
        chance = (np.pad(chance, (0, step)) + np.pad(chance, (step, 0))) / 2
    return min(1.0, 2.0 * float(chance[: math.floor(2 * w + 1e-9) + 1].sum()))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(x, df, strict=True)
    return pd.Series([None if pd.isna(a) else chi2_tail(float(a), int(b)) for a, b in pairs])


@F.pandas_udf(T.DoubleType())
def signed_rank_p(ranks: pd.Series, w: pd.Series) -> pd.Series:
    pairs = zip(ranks, w, strict=True)
    return pd.Series([signed_rank_tail([float(v) for v in r], float(x)) for r, x in pairs])
