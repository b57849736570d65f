"""Spelling variants: words one code point apart, found by pivotal grams.

Bigrams are ordered by how many words hold them, rarest first. A word's prefix is its three
first bigrams; one edit touches at most two neighbouring ones, so of any two disjoint
bigrams one survives. The two disjoint bigrams of the prefix with the least total frequency,
chosen by dynamic programming, are the word's pivots. If two words are near, the pivots of
the one whose prefix ends no later meet the prefix of the other.

Position limits are taken at their sharpest. A surviving pivot stands at the same distance
from the start, with all the text before it equal (the edit is to its right), or at the same
distance from the end, with all after it equal. The part beyond the pivot that may hold the
edit is halved: the half without the edit is equal too. So an index key is the pivot with
equal text around it, hashed, and few words share one. All candidates are verified.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.words import GOLDEN, arrow_map, mixed, slices
from scoutlake.session import stage

MIN_LENGTH = 7  # code points of a word
MIN_COUNT = 2
SLIPS = 31  # a run whose crc32 this divides loses a code point
RATIO = 10  # a form is so many times as frequent

LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
SYMBOLS = 26 + 64  # a-z, U+00C0-U+00FF
GRAMS = SYMBOLS * SYMBOLS
PREFIX = 3  # bigrams of a prefix: two touched by one edit, and one more
INDEXED = 5  # an edit puts at most two new bigrams before a surviving one
LONG = 64  # bytes from which on a run is hashed by itself
BASE = 0xD1B54A32D192ED03

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of letters in lower-cased bytes of several texts."""
    lead = data == LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    border = edges[(edges > 0) & (edges < len(data))]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    begins[border] |= inside[border]
    finishes[border - 1] |= inside[border - 1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from the crc32 in ``seeds``; one byte of all spans at a time."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -LONG, "left") :]
    state = ~seeds[order]
    first, falling = starts[order], -lengths[order]
    for k in range(int(-falling[0]) if len(order) else 0):
        live = int(np.searchsorted(falling, -k, "left"))
        now = state[:live]
        state[:live] = _CRC[(now ^ data[first[:live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(lengths >= LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(seeds[i]))
    return out


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray) -> pa.StringArray:
    """The runs as words: slips lose a code point, short words are left out."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.searchsorted(heads, starts)
    size = np.searchsorted(heads, ends) - before
    slip = crc % SLIPS == 0
    kept = size - slip >= MIN_LENGTH
    starts, ends, before, size, slip, crc = (x[kept] for x in (starts, ends, before, size, slip, crc))
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    lost = heads[before[slip] + crc[slip] % size[slip]]
    at = lost - starts[slip] + offsets[:-1][slip]
    wide = data[lost] == LEAD
    stay = np.ones(len(out), bool)
    stay[at] = False
    stay[at[wide] + 1] = False
    lengths[slip] -= 1 + wide
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(out[stay]))


def _count_batch(batch):
    ids = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
    for part in slices(batch):
        starts, ends = _runs(part.data, part.byte_offsets)
        of_text = np.searchsorted(part.byte_offsets, starts, "right") - 1
        crc = _crc32(part.data, starts, ends, ids[part.row + of_text])
        found = _spelled(part.data, starts, ends, crc).value_counts()
        yield pa.record_batch([found.field("values"), found.field("counts")], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of ``docs`` (doc_id, text) with slips, found ``MIN_COUNT`` times or more."""
    told = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = arrow_map(told, "word string, n long", _count_batch).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


class Spellings:
    """Words of a batch as symbols: letters in rows one after the other."""

    def __init__(self, words: pa.Array):
        edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        second = data[np.minimum(heads + 1, len(data) - 1)]
        self.symbols = np.where(data[heads] == LEAD, second - 0x80 + 26, data[heads] - ord("a")).astype(np.int64)
        self.offsets = np.searchsorted(heads, edges - edges[0])
        self.sizes = np.diff(self.offsets)

    def __len__(self) -> int:
        return len(self.sizes)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, word, place) of every bigram in order."""
        word = np.repeat(np.arange(len(self)), self.sizes - 1)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes - 1) - (self.sizes - 1), self.sizes - 1)
        at = self.offsets[word] + place
        return self.symbols[at] * SYMBOLS + self.symbols[at + 1], word, place

    def hasher(self):
        """hash(word, start, end) of spans of symbols, for arrays of them."""
        n = len(self.symbols) + 1
        power, inverse = (np.full(n, np.uint64(b)) for b in (BASE, pow(BASE, -1, 2**64)))
        power[0] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(n, np.uint64)
        np.cumsum(mixed((self.symbols + 1).astype(np.uint64) * GOLDEN) * power[:-1], out=sums[1:])

        def of(word, start, end):
            a, b = self.offsets[word] + start, self.offsets[word] + end
            return mixed((sums[b] - sums[a]) * inverse[a] + (end - start).astype(np.uint64))

        return of


def _chunks(batch, column="word"):
    """Batches of bounded text."""
    words = batch.column(batch.schema.get_field_index(column))
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    row = 0
    while row < len(words):
        to = max(int(np.searchsorted(edges, edges[row] + (1 << 18), "right")) - 1, row + 1)
        yield batch.slice(row, to - row)
        row = to


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the ``GRAMS`` bigrams occurs in the words; a table of fixed size."""

    def make(batch):
        for part in _chunks(batch):
            found = np.bincount(Spellings(part.column(0)).grams()[0], minlength=GRAMS)
            gram = np.flatnonzero(found)
            yield pa.record_batch([pa.array(gram), pa.array(found[gram])], names=["gram", "n"])

    out = np.zeros(GRAMS, np.int64)
    for row in arrow_map(words.select("word"), "gram long, n long", make).groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def prefixes(words: Spellings, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of the ``INDEXED`` first bigrams of each word, a row each, in the global
    order: rarest first, then by place."""
    order = np.lexsort((np.arange(GRAMS), counts))
    rank = np.empty(GRAMS, np.int64)
    rank[order] = np.arange(GRAMS)
    gram, word, place = words.grams()
    ranks = rank[gram]
    by = np.argsort(word * GRAMS + ranks, kind="stable")
    first = np.cumsum(words.sizes - 1) - (words.sizes - 1)
    some = by[first[:, None] + np.arange(INDEXED)]
    return place[some], ranks[some]


def pivots(places: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Two disjoint bigrams of each row of ``places`` with the least total cost, by dynamic
    programming over the places in order: cheapest of one, then of two ending here."""
    order = np.argsort(places, axis=1)
    places, costs = np.take_along_axis(places, order, 1), np.take_along_axis(costs, order, 1)
    n = np.arange(len(places))
    least = np.full(len(places), np.iinfo(np.int64).max)
    best = np.zeros((len(places), 2), np.int64)
    for j in range(1, places.shape[1]):
        apart = places[:, :j] + 2 <= places[:, j : j + 1]
        one = np.where(apart, costs[:, :j], np.iinfo(np.int64).max // 4)
        mate = one.argmin(1)
        total = one[n, mate] + costs[:, j]
        better = apart[n, mate] & (total < least)
        least = np.where(better, total, least)
        best[better] = np.stack([places[n, mate], places[:, j]], 1)[better]
    return best


def _keys(hashed, word, size, shift, left, right):
    """Index keys of words whose pivots stand at ``left`` from the start and ``right`` from the
    start of the pivots' owner, which has ``size`` code points; the word has ``shift`` more.

    Left: the edit is right of the pivot, in the half beyond ``half`` or before it. Right:
    the edit is left of the pivot, before ``half`` or beyond it. Returns (use, key) each.
    """
    own = size + shift
    zero = np.zeros_like(word)
    out = []

    def key(kind, use, *spans):
        h = (size[use] * 4 + kind).astype(np.uint64)
        for a, b in spans:
            h = mixed(h * GOLDEN + hashed(word[use], a[use], b[use]))
        out.append((use, h))

    end = left + 2
    half = end + (size - end) // 2
    key(0, np.flatnonzero((end <= size) & (half <= own)), (zero, half))
    key(1, np.flatnonzero((end <= size) & (half > end)), (zero, end), (half + shift, own))
    half = right // 2
    fits = (right >= 2) & (right + 2 <= size)
    key(2, np.flatnonzero(fits), (half + shift, own))
    key(3, np.flatnonzero(fits), (zero, half), (right + shift, own))
    return out


SIGNED = "key long, word string, n long, last int"


def _signed(counts: np.ndarray, index: bool):
    """Rows (key, word, n, last): pivots of words, or their indexed prefixes."""

    def make(batch):
        for part in _chunks(batch):
            words = Spellings(part.column(0))
            places, ranks = prefixes(words, counts)
            hashed, last = words.hasher(), ranks[:, PREFIX - 1]
            if index:
                row, k = np.nonzero((np.arange(INDEXED) < PREFIX) | (ranks == last[:, None]))
                place, size = places[row, k], words.sizes[row]
                found = []
                for shift in (-1, 0, 1):  # the owner of the pivots is so much shorter
                    for use, h in _keys(hashed, row, size - shift, np.full(len(row), shift), place, place - shift):
                        found.append((row[use], h))
            else:
                row = np.arange(len(words))
                cost = np.sort(counts)[ranks[:, :PREFIX]]
                two = pivots(places[:, :PREFIX], cost)
                found = _keys(hashed, row, words.sizes, np.zeros(len(row), np.int64), two[:, 0], two[:, 1])
            row = np.concatenate([r for r, _ in found])
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([h for _, h in found]).view(np.int64)),
                    part.column(0).take(pa.array(row)),
                    part.column(1).take(pa.array(row)),
                    pa.array(last[row].astype(np.int32)),
                ],
                names=["key", "word", "n", "last"],
            )

    return make


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n), a < b: pairs of ``words`` (word, n) that differ by exactly one inserted,
    deleted or replaced code point. Words are distinct, of a-z and U+00C0-U+00FF, with at
    least ``INDEXED`` + 1 code points."""
    counts = gram_counts(words)
    told = words.select("word", "n")
    left = arrow_map(told, SIGNED, _signed(counts, index=False)).alias("p")
    right = arrow_map(told, SIGNED, _signed(counts, index=True)).alias("i")
    met = left.join(
        right,
        F.expr("p.key = i.key AND p.last <= i.last AND p.word <> i.word AND levenshtein(p.word, i.word, 1) = 1"),
    )
    return met.selectExpr(
        "least(p.word, i.word) AS a",
        "greatest(p.word, i.word) AS b",
        "IF(p.word < i.word, p.n, i.n) AS a_n",
        "IF(p.word < i.word, i.n, p.n) AS b_n",
    ).distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by doubling the steps. Forms
    are ``RATIO`` times as frequent as their words, so chains are short and without circles."""
    hops = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stage(hops.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``docs`` (doc_id, text).

    Words are runs of letters, A-Z lower-cased, of ``MIN_LENGTH`` code points or more and
    found ``MIN_COUNT`` times or more. A null doc_id counts as empty text in the slips, a null
    text has no words; repeated rows count each, other columns are ignored. ``form`` and
    ``form_n`` are null, and ``root`` the word itself, without a near word ``RATIO`` times as
    frequent; ties go to the word that is first in code-point order.
    """
    words = stage(word_counts(docs), "words")
    both = near_pairs(words).selectExpr(
        "explode(array(named_struct('word', a, 'n', a_n, 'near', b, 'near_n', b_n), named_struct('word', b, 'n', b_n, 'near', a, 'near_n', a_n))) AS s"
    ).select("s.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    near = stage(best.selectExpr("word", "n_near", "best.near", "-best.less AS near_n"), "near")
    judged = words.join(near, "word", "left").withColumn("_formed", F.expr(f"coalesce(near_n >= {RATIO} * n, false)"))
    judged = stage(
        judged.selectExpr("word", "IF(_formed, near, null) AS form", "n", "coalesce(n_near, 0L) AS n_near", "IF(_formed, near_n, null) AS form_n"),
        "judged",
    )
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
