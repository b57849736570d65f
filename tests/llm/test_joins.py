"""N-gram join, decontamination, mixing, URL filter."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from texts import CLASH, SCHEMA, SF, rows_of

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import compare  # noqa: E402

from scoutlake.llm import decontam, mixing, ngram_join, queries, urls  # noqa: E402
from scoutlake.llm.graph import components  # noqa: E402


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size=4, percent=85):
    sets = [(d, shingles(t, size)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), None if d is None else top(d)) for d, s in sets if d is not None)


def near_copies(n=160, seed=3):
    """Chains of near copies, copies of one original, and texts that share one line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(n // 16):
        base = [word() for _ in range(rng.choice((9, 40, 90)))]
        for _ in range(8):  # copies of the original
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        for _ in range(4):  # a chain
            base = list(base)
            base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
        texts += [line + " " + " ".join(word() for _ in range(rng.randrange(4))) for _ in range(3)]
        texts.append(texts[-1].upper())
    rng.shuffle(texts)
    return rows_of(texts)


@pytest.mark.parametrize("crowd", [256, 0])
def test_join_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)  # 0: as many pivots as allowed
    rows = near_copies()
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_join_edges(spark, edge, empty):
    got = ngram_join.ngram_components(edge).collect()
    assert len(got) == 13 and all(r.component_id is None for r in got if r.doc_id is None)
    told = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert told[2] == (0, 2) and told[3] == (0, 3) and told[4] == (0, 4)
    assert told[5] == (15, 1) and told[1] == (15, 1) and told[6] == (1, 6) and told[7][0] == 3997
    assert ngram_join.ngram_components(empty).collect() == []


def test_follower_in_one_group_still_leads_another(spark):
    rows = [(3, 40, 1, 9, [11, 12]), (5, 40, 1, 9, [11, 12]), (5, 50, 2, 9, [21, 22]), (9, 50, 2, 9, [21, 22]), (7, 50, 3, 9, [22, 23])]
    prefixes = spark.createDataFrame(rows, "doc_id long, n long, grp long, rare long, prefix array<long>")
    got = ngram_join._postings(prefixes, ngram_join._groups(prefixes))
    assert sorted((r.tok, r.lead, r.pos, r.n) for r in got.collect()) == [(22, 5, 1, 50), (22, 7, 0, 50)]


def test_repeated_ids_with_different_texts_match_brute_force(spark):
    rows = [(d % 60 if d % 3 else d, t, *rest) for d, t, *rest in near_copies(90, 5) if d is not None]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 150: 100}


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_leaks(spark, edge, empty):
    words = ITEM.split()
    one_off = [*words[:-1], "other"]
    texts = [
        "before it " + ITEM + " after it",
        "Before; " + ITEM.upper().replace(" ", ",\n") + "!",
        " ".join(one_off),  # 15 of 17 different shingles
        " ".join(words[:10]),  # too little of it
        " ".join(reversed(words)),
        "",
        None,
        ITEM,
    ]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    bench = spark.createDataFrame(
        [(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "too few words", "x"), (None, "one two three four five six", "x")],
        "item_id long, text string, mark string",
    )
    got = {(r.doc_id, r.item_id): (round(r.similarity, 4), r.start) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1): (1.0, 2), (2, 1): (1.0, 1), (3, 1): (round(15 / 17, 4), 0), (8, 1): (1.0, 0)}
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert decontam.leaks(empty, bench).collect() == [] and decontam.leaks(docs, bench.limit(0)).collect() == []
    assert decontam.decontaminated(edge, bench).count() == edge.count()


def test_index_meets_every_pair_in_the_radius(spark):
    rng = random.Random(5)
    marks = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    near = [(k, m ^ sum(1 << b for b in rng.sample(range(63), decontam.RADIUS))) for k, m in enumerate(marks)]
    index = decontam._exploded_blocks(spark.createDataFrame(list(enumerate(marks)), "id long, mark long"), decontam.FLIPS)
    probe = decontam._exploded_blocks(spark.createDataFrame(near, "own long, mark long"), 0).drop("mark")
    met = index.join(probe, ["block", "value"]).where("id = own").select("id").distinct().count()
    assert met == 20


def test_mixing_edges(spark, edge, empty):
    got = mixing.taken(edge).collect()
    assert len(got) == 13 and all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken(edge).collect()), key=repr)
    assert mixing.taken(empty).collect() == []
    kept = mixing.mixture(edge)
    assert kept.columns == [*edge.columns, "repeats"] and set(CLASH) <= set(kept.columns)


def test_water_filling(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 20, 8), (None, 500, 2)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got["a"] == 30 and got["c"] == 60 and got["b"] == pytest.approx(1440 / 3) and got[None] == pytest.approx(960)


def test_taken_words_come_near_the_targets(documents):
    mixed = mixing.taken(documents).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in mixed.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


def test_url_edges(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://a.EXAMPLE.net/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://net?q": ("net", "", None, "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://casino.org/fr/": ("casino.org", "/fr/", "org/fr/", "allow"),
        "https://a.com/casino-x": ("a.com", "/casino-x", None, "block"),
        "https://a.com/casinox": ("a.com", "/casinox", None, "allow"),
        "https://free.com/free/free": ("free.com", "/free/free", None, "allow"),
        "https://free.com/cheap": ("free.com", "/cheap", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(k, u, "x") for k, u in enumerate(cases)] + [(None, None, "x"), (0, next(iter(cases)), "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [by[k] for k in range(len(cases))] == list(cases.values()) and by[None] == ("", "", None, "allow")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = compare.oracle_connection(SF)
    state, *_ = compare.compare(spark, con, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert state == "ok"
