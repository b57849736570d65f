"""The spacing chain: known answers, and the tree for heavy keys against the fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scoutlake.functions.chains import latest_node, spaced_chain
from scoutlake.operators.alerts import cool_down

STARTS = [0.0, 30.0, 60.0, 61.0, 100.0, 121.0, 122.0]


def brute(times, gap, inclusive):
    kept = []
    for t in sorted(set(times)):
        if not kept or (t - kept[-1] >= gap if inclusive else t - kept[-1] > gap):
            kept.append(t)
    return kept


def test_incident_anchors(spark):
    rows = spark.createDataFrame([("k", t) for t in STARTS], "k string, t double")
    nodes = spaced_chain(rows, ["k"], "t", 60.0, inclusive=False)
    placed = latest_node(rows, nodes, ["k"], "t", 60.0).orderBy("t").collect()
    assert [r["node"] for r in placed] == [0, 0, 0, 61, 61, 61, 122]


def test_cool_down(spark):
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate([*STARTS, 0.0])], "k string, t double, i int")
    passed = cool_down(rows, ["k"], "t", "i").orderBy("t").collect()
    assert [(r["t"], r["i"]) for r in passed] == [(0.0, 0), (61.0, 3), (122.0, 6)]


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("fan_out", [2, 5])
def test_tree_equals_fold_and_brute_force(spark, inclusive, fan_out):
    rng = random.Random(7)
    data = {
        "dense": [rng.uniform(100, 700) for _ in range(4000)],
        "grid": [float(i) for i in range(0, 600, 3)],
        "gappy": [rng.choice([5, 2000, 2500, 9000]) + rng.uniform(0, 40) for _ in range(300)],
        "single": [77.0],
    }
    rows = spark.createDataFrame([(k, t) for k, ts in data.items() for t in ts], "k string, t double")
    for limit in (10**6, 50, 0):
        nodes = spaced_chain(rows, ["k"], "t", 30.0, inclusive, limit=limit, fan_out=fan_out)
        got = {k: sorted(r["node"] for r in nodes.filter(F.col("k") == k).collect()) for k in data}
        assert got == {k: brute(ts, 30.0, inclusive) for k, ts in data.items()}, limit
