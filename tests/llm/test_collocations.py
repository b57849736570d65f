"""Collocations against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scoutlake.llm import collocations

A_TO_Z = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


SCHEMA = "doc_id long, text string, lang string"


def numbered(rows):
    return [(k // 2, *r) for k, r in enumerate(rows)]


def counts_by_hand(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(A_TO_Z)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    return f, n


def by_hand(rows, least, top):
    f, n = counts_by_hand(rows)
    out = []
    for lang, counts in f.items():
        big = {p: c for p, c in counts.items() if c >= least}
        kept = []
        for p, a in big.items():
            if len(p) < 2:
                continue
            longer = [
                q for q in big if len(q) > len(p) and big[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if longer:
                continue
            score, cut = min((1000 * a * n[lang] // (counts[p[:j]] * counts[p[j:]]), j) for j in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed, docs=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "x y", "日本"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for d in range(docs):
        words = list(rng.choice(vocabulary, rng.integers(0, 40), p=weight / weight.sum()))
        if d % 3 == 0:
            at = rng.integers(0, len(words) + 1)
            words[at:at] = ["New", "york", "stock", "exchange", "INDEX", "fund"][: rng.integers(2, 7)]
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "; "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])) for w in words)
        rows.append((text, [None, "en", "de", "en"][d % 4]))
    return rows


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_by_brute_force_whatever_the_sample(spark, share):
    """A poor sample (or none) costs passes, never phrases."""
    rows = made(2)
    got = collocations.collocations(spark.createDataFrame(numbered(rows), SCHEMA), 8, 40, share)
    want = by_hand(rows, 8, 40)
    assert len({len(r[2].split()) for r in want}) >= 3
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_border_failures_are_expanded(spark):
    """Proposals that miss everything but two words: later passes find all phrases."""
    rows = made(4)
    docs = spark.createDataFrame([(t, "en" if la is None else la) for t, la in rows], "text string, lang string")
    f, n = counts_by_hand([(t, "en" if la is None else la) for t, la in rows])
    want = sorted((la, len(p), " ".join(p), c) for la in f for p, c in f[la].items() if c >= 8)
    want += [(la, 0, "", n[la]) for la in n]
    proposals = spark.createDataFrame([("en", "new"), ("en", "york"), ("de", "nowhere to be found")], "lang string, phrase string")
    got = collocations.frequent_phrases(docs, 8, proposals).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With a tiny filter nearly everything passes and is counted exactly."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    rows = made(5, 120)
    got = collocations.collocations(spark.createDataFrame(numbered(rows), SCHEMA), 5, 30)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 5, 30)


def test_edge_tables(spark, edge, empty):
    rows = [(r["text"], r["lang"]) for r in edge.collect()]
    got = collocations.collocations(edge, 2, 50)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 2, 50)
    assert collocations.collocations(empty, 2, 50).count() == 0


def test_products_beyond_64_bits(spark):
    big = 9 * 10**14
    rows = [("en", 0, "", big), ("en", 1, "a", big // 3), ("en", 1, "b", big // 7), ("en", 2, "a b", big // 11)]
    got = collocations.scored(spark.createDataFrame(rows, collocations.COUNTED)).collect()
    assert [r["score"] for r in got] == [1000 * (big // 11) * big // ((big // 3) * (big // 7))]


def test_seldom_phrases_are_not_shuffled(spark):
    # Word pairs that all differ, beside one that is frequent: only short hashes of the others travel.
    texts = [f"w{k % 50} v{k // 50}" for k in range(2500)] + ["good morning"] * 100
    rows = numbered([(t, "en") for t in texts])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text")
    words = collocations.filter_of(spark.createDataFrame([("en", w) for w in [f"w{k}" for k in range(50)] + [f"v{k}" for k in range(50)] + ["good", "morning"]], "lang string, phrase string"))
    often = collocations.often_hashed(docs, [words], 50)
    got = {r.phrase: r.n for r in collocations.pass_over(docs, [words], often=often).where("k > 0").collect()}
    assert got["good morning"] == 100 and got["w7"] == 50 and got["v7"] == 50
    assert not [p for p in got if p.startswith("w") and " " in p]
