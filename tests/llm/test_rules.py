"""Quality by sparse rules: statistics by hand, compiled rules against plain ones, held-out labels."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import SF

from scoutlake.llm import rules

WORD = re.compile("[^ \t-\r]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    letters = [c for c in text if c.isascii() and c.isalpha() or ord(c) > 127]
    lines = [x for x in text.split("\n") if any(c in letters for c in x)]
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]

    def share(a, b):
        return a / b if b else 0.0

    return [
        math.log1p(len(words)),
        share(chars, len(words)),
        share(len(re.findall(r"[#*$%&|<>~^=+_{}\[\]\\@/]", text)), chars),
        share(len(re.findall("[!?]", text)), len(words)),
        share(len(re.findall("[.,;:]", text)), len(words)),
        share(len(re.findall("[A-ZÀ-Þ]", text)), len(letters)),
        share(len(re.findall("[0-9]", text)), chars),
        share(sum(not any(c in letters for c in w) for w in words), len(words)),
        share(sum(a == b for a, b in zip(lowered, lowered[1:], strict=False)), len(words)),
        share(len(set(lowered)), len(words)),
        share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(share(len(words), len(lines))),
        math.log1p(max(map(len, words), default=0)),
    ]


def test_statistics_by_hand(spark, documents, edge):
    more = [(1, "One line.\nONE line.\nOne line.\n\n###\nÀ É × é 12 a_b"), (2, "\n\n"), (3, "x x X\ty!?"), (4, "no end\nno end")]
    rows = spark.createDataFrame(more, "doc_id long, text string").union(edge.where("doc_id <> 8").select("doc_id", "text"))
    rows = rows.union(documents.select("doc_id", "text").limit(60))
    told = rows.select(F.struct("doc_id", F.col("text").alias("own")).alias("key"), "text")
    for r in rules.with_statistics(told).collect():
        assert np.allclose(list(r)[1:], by_hand(r.key.own), rtol=1e-6), r.key


def test_compiled_rules_are_the_rules(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, len(rules.STATS))).astype(np.float32).astype(float)
    y = ((x[:, 2] < 0.4) & (x[:, 5] > 0.3)).astype(float)
    found = rules.boosted_paths(x, y, np.ones(len(y)), rng)
    assert len(found.low) > 20
    weight = rng.normal(0, 1, len(found.low)).astype(np.float32)
    want = 1 / (1 + np.exp(-(found(x) @ weight.astype(float) + 0.25)))
    model = {"low": found.low.astype(np.float32), "high": found.high.astype(np.float32), "weight": weight, "offset": [0.25]}
    names = [rules.PREFIX + s for s in rules.STATS]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names))
    assert np.allclose([r[0] for r in frame.select(rules.compiled(model)).collect()], want)


def test_lasso_keeps_few_rules():
    rng = np.random.default_rng(8)
    holds = rng.random((800, 40)) < 0.5
    y = (rng.random(800) < np.where(holds[:, 3] & holds[:, 7], 0.9, 0.1)).astype(float)
    holds[:, 0] = holds[:, 3] & holds[:, 7]
    w = rules.lasso(holds, y, np.ones(800), 0.03, np.zeros(41))
    assert w[0] > 1 and (np.abs(w[:-1]) > 1e-4).sum() < 10
    p = 1 / (1 + np.exp(-(holds @ w[:-1] + w[-1])))
    slope = holds.T @ (p - y) / 800  # the conditions of the optimum
    assert np.all(np.abs(slope) < 0.03 + 1e-3) and abs((p - y).mean()) < 1e-3


@pytest.fixture(scope="module")
def tables(spark):
    at = SF.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_held_out_labels(tables):
    docs, labels = tables
    got = rules.score_documents(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == h for d, h in zip(got.doc_id, got.held_out, strict=True))
    apart = got[got.held_out]
    rank, good = apart.score.rank(), apart.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and apart.predicted[good].mean() > 0.95 and apart.predicted[~good].mean() < 0.2
    assert ((got.score >= rules.GOOD) == (got.predicted == 1)).all()


def test_edges(spark, edge, empty):
    kinds = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (6, 0, "x"), (8, None, "x"), (None, 1, "x"), (99, 0, "x")], kinds)
    got = rules.score_documents(edge, labels, F.lit(True)).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in rules.score_documents(edge, labels.limit(0)).collect()} == {0.5}
    assert all(r.predicted == 1 for r in rules.score_documents(edge, labels.where("quality = 1")).collect())
    assert rules.score_documents(empty, labels).collect() == []


def test_samples_are_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 2900) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS INT) AS toxic")
    rows, shares = rules.labelled_sample(docs, labels, "toxic", F.lit(True), 200)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert shares[1] == 200 / 300 and 150 < n[0] < 260 and 150 < n[1] < 260
    again = rules.labelled_sample(docs.repartition(7), labels, "toxic", F.lit(True), 200)[0]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
