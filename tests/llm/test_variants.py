"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

from scoutlake.llm import variants

A_TO_Z = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def by_hand(rows):
    n = words_by_hand(rows)
    mates = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in mates.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(mates[w]), n[form[w]] if form[w] else None)
    return out


def found(spark, rows):
    df = variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len({g[0] for g in got})
    return {g[0]: g[1:] for g in got}


def test_small_words_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    stems = ["".join(rng.choice(list("abé"), rng.integers(7, 10))) for _ in range(12)]
    for doc in range(150):
        words = []
        for _ in range(30):
            w = stems[rng.integers(0, len(stems)) * rng.integers(0, 2)]
            for _ in range(rng.integers(0, 3)):
                at, kind = rng.integers(0, len(w) + 1), rng.integers(0, 3)
                w = w[:at] + ("" if kind == 0 else str(rng.choice(list("abéÿ")))) + w[at + (kind > 0) * rng.integers(0, 2) :]
            words.append(w)
        rows.append((doc, " ".join(words)))
    want = by_hand(rows)
    assert any(v[0] for v in want.values()) and max(v[3] for v in want.values()) > 5
    assert found(spark, rows) == want


def test_chains_of_forms(spark):
    line = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    rows = [(k, " ".join([w] * 10 ** (3 - i))) for i, w in enumerate(line) for k in (5 * i, 5 * i + 2)]
    want = by_hand(rows)
    assert want["abcdezyx"][1] == "abcdefgh"
    assert found(spark, rows) == want


def test_repeats_and_long_runs(spark):
    rows = [(k, t) for k, t in enumerate(["z" * 3000, "z" * 3000, "z" * 2999, "z" * 2999, "z" * 1500 + "a" + "z" * 1499] * 2)]
    rows += [(None, "aaaaaaa aaaaaaaa AAAAAAA aaaaaaaa ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ"), (1, None), (2, ""), (3, "x1y2")]
    rows += [(9, "×÷×÷×÷×÷ ×÷×÷×÷×÷ 日本 naïvetés_naïvetés")] * 2
    assert found(spark, rows) == by_hand(rows)


def test_edge_tables(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = {r["word"]: tuple(r)[1:] for r in variants.variants(edge).collect()}
    assert got == by_hand(rows)
    assert variants.variants(empty).count() == 0


def test_whole_table_words(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["word"]: r["n"] for r in variants.word_counts(documents).collect()}
    assert got == words_by_hand(rows)


def test_pivots_by_brute_force():
    rng = np.random.default_rng(1)
    places = np.array([rng.choice(9, 3, replace=False) for _ in range(300)])
    costs = rng.integers(0, 50, (300, 3))
    for p, c, got in zip(places, costs, variants.pivots(places, costs), strict=True):
        cost = dict(zip(p, c, strict=True))
        least = min(cost[a] + cost[b] for a in p for b in p if b - a >= 2)
        assert got[1] - got[0] >= 2 and cost[got[0]] + cost[got[1]] == least
