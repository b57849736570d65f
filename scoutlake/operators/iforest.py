"""Isolation forest as Spark jobs: a hash sample per tree, one small group per tree to
build it, and vectorised scoring with the (bounded) forest shipped to the tasks.

Scores follow one sign everywhere: higher is more anomalous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "tree int, node int, feature int, threshold double, left int, right int, length double"


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


@dataclass
class IsolationForest:
    features: list[str]
    nodes: pd.DataFrame
    trees: int
    sample: int
    cut: float = 0.0

    def anomaly(self, df: DataFrame, name: str = "anomaly") -> DataFrame:
        """Adds 2^(-mean path / expected path), in 0..1."""
        spark = df.sparkSession
        packed = {
            int(t): g.sort_values("node")[["feature", "threshold", "left", "right", "length"]].to_numpy()
            for t, g in self.nodes.groupby("tree")
        }
        # At most trees * (2 * sample - 1) rows, whatever the size of the data.
        shared = spark.sparkContext.broadcast(packed)
        expected = mean_path(self.sample)

        @F.pandas_udf(T.DoubleType())
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            rows = np.arange(len(x))
            depth = np.zeros(len(x))
            for table in shared.value.values():
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = table[at, 0].astype(int)
                    inner = feature >= 0
                    if not inner.any():
                        break
                    low = x[rows, np.maximum(feature, 0)] < table[at, 1]
                    step = np.where(low, table[at, 2], table[at, 3]).astype(int)
                    at = np.where(inner, step, at)
                depth += table[at, 4]
            mean = depth / max(len(shared.value), 1)
            return pd.Series(np.power(2.0, -mean / expected) if expected > 0 else np.full(len(x), 0.5))

        return df.withColumn(name, score(*[F.col(f).cast("double") for f in self.features]))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (logistic of the distance to the cut) and ``prediction``."""
        margin = F.col("anomaly") - F.lit(self.cut)
        return self.anomaly(df).withColumns(
            {
                "score": F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)),
                "prediction": (margin >= 0).cast("int"),
            }
        )


def tree_samples(df: DataFrame, row_id: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, row) samples without replacement: per tree the rows of smallest hash.

    Every row is tested against a hash bound first, so about four times the sample is
    ranked per tree and nothing else leaves the scan.
    """
    n = max(df.count(), 1)
    space = 1 << 30
    bound = min(space, math.ceil(4.0 * sample / n * space))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))

    def drawn(t):
        return F.struct(t.alias("tree"), F.pmod(F.xxhash64(F.col(row_id), F.lit(seed), t), F.lit(space)).alias("h"))

    hits = F.filter(F.transform(numbers, drawn), lambda s: s["h"] < bound)
    order = Window.partitionBy("tree").orderBy("h", row_id)
    return (
        df.withColumn("_s", F.explode(hits))
        .select("*", "_s.*")
        .drop("_s")
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= sample)
        .drop("_r", "h")
    )


def fit(
    df: DataFrame, features: list[str], row_id: str, trees: int = 100, sample: int = 256,
    contamination: float = 0.1, seed: int = 42,
) -> IsolationForest:
    depth_limit = math.ceil(math.log2(max(sample, 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(row_id)[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        table: list[list[float]] = []
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            here = len(table)
            if parent >= 0:
                table[parent][2 + side] = here
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.nonzero(high > low)[0]
            if depth >= depth_limit or len(rows) <= 1 or not len(usable):
                table.append([-1, 0.0, -1, -1, depth + mean_path(len(rows))])
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            below = x[rows, f] < cut
            table.append([f, cut, -1, -1, 0.0])
            todo.append((rows[~below], depth + 1, here, 1))
            todo.append((rows[below], depth + 1, here, 0))
        out = pd.DataFrame(table, columns=["feature", "threshold", "left", "right", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out.astype({"feature": int, "left": int, "right": int})

    picked = tree_samples(df.select(row_id, *features), row_id, trees, sample, seed)
    nodes = picked.groupBy("tree").applyInPandas(build, NODES).toPandas()
    forest = IsolationForest(features, nodes, trees, max(df.limit(sample).count(), 1))
    scored = forest.anomaly(df.select(row_id, *features))
    cut = scored.agg(F.percentile_approx("anomaly", 1.0 - contamination, 10000)).first()[0]
    forest.cut = float(cut if cut is not None else 0.5)
    return forest
