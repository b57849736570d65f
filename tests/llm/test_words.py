from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scoutlake.llm import words
from scoutlake.llm.subwords import subwords, word_sums

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\n\t\r\x0b\x0c\x1c\x85　日", max_size=40)), min_size=1, max_size=12)


def batch(texts):
    return pa.record_batch([pa.array(texts, pa.string())], names=["text"])


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    got, seen = [], {}
    for part in words.slices(batch(texts)):
        spans = [part.data[a:b].tobytes() for a, b in zip(part.starts, part.ends, strict=True)]
        for word, h in zip(spans, part.hashes().tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        got += [spans[a:b] for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_small_slices_and_long_words_give_the_same(monkeypatch):
    texts = ["a b c " * 50, "q" * 5000, None, "tail", "x " + "y" * 900 + " z"]
    whole = [s.tolist() for p in words.slices(batch(texts)) for s in words.shingle_sets(p, 4)]
    monkeypatch.setattr(words, "SLICE", 64)
    assert [s.tolist() for p in words.slices(batch(texts)) for s in words.shingle_sets(p, 4)] == whole


def test_sliced_batches():
    part = batch([None, "a b", "c", "d e f"]).slice(1, 2)
    assert [np.diff(p.offsets).tolist() for p in words.slices(part)] == [[2, 1]]


def test_lookup():
    rng = np.random.default_rng(1)
    known = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    find = words.Lookup(known)
    probe = np.concatenate([known, rng.integers(0, 2**63, 500).astype(np.uint64), [np.uint64(2**64 - 1)]])
    got = find(probe)
    assert np.array_equal(got >= 0, np.isin(probe, known)) and np.array_equal(known[got[got >= 0]], probe[got >= 0])
    assert (words.Lookup(known[:0])(probe) == -1).all()


def test_subwords_stay_inside_words():
    part = next(words.slices(batch(["abcd ef", "g"])))
    table = np.ones((1 << 12, 1))
    sums, counts = word_sums(part, table, (3, 4), 12)
    # " abcd ", " ef ", " g ": lengths 6, 4 and 3 with their borders.
    assert counts.tolist() == [4 + 3, 2 + 1, 1] and sums[:, 0].tolist() == counts.tolist()
    same = {w: sorted(b[i == k].tolist()) for i, b in subwords(part, (3,), 12) for k, w in enumerate("aeg")}
    assert len(same["a"]) == 4 and len(same["g"]) == 1


def test_shingle_sets_in_pieces_are_the_same(monkeypatch):
    part = next(words.slices(batch(["a b c d e f g", "", None, "h", "a b a b a b", "x " * 50])))
    whole = [s.tolist() for s in words.shingle_sets(part, 3)]
    monkeypatch.setattr(words, "PIECE", 4)
    assert len(list(words.pieces(part))) > 1
    assert [s.tolist() for s in words.shingle_sets(part, 3)] == whole
