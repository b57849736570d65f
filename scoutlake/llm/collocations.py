"""Collocations: phrases whose words occur together far more often than apart, by sampling.

Frequent phrases are mined as Toivonen does. A sample of the documents proposes the phrases
that are frequent there at a lowered limit. One full pass then counts the proposals and their
negative border exactly: any phrase whose first and last words but one are both proposed, and
every single word. Frequent phrases of the border that were not proposed are failures; they
join the proposals, and a further full pass counts all that their extensions need, however
long. Then every frequent phrase has been counted, whatever the sample was: its two parts
are frequent, so they were proposed or join, or that pass reaches and extends them.

The proposals reach the tasks as a filter of fixed size: bits at hashes of the phrases. What
passes it by chance is counted too and drops out by its count, so no result depends on it.
Counts are kept by the phrases themselves, not by hashes. Where the border is large, short
hashes are counted first: a hash counts all phrases that have it, so a phrase whose hash is
found too seldom is not frequent, and only the text of the others is shuffled and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.llm.words import GOLDEN, Slice, arrow_map, mixed, slices, span_hashes
from scoutlake.session import small_table, stage

WORDS = 5  # of the longest phrase
MIN_COUNT = 100
TOP = 2000  # phrases reported per language
KEEP_PERCENT = 100  # a phrase goes if a longer one has this share of its count
SHARE = 0.125  # of the documents in the sample
EASE = 0.9  # the sample's limit, as a share of the limit scaled to it
PART = 1 << 21  # bytes of text counted at once
FILTER_BITS = 25  # log2 of the bits of the filter, which is all that is broadcast
NO_LANG = "und"
SHORT = np.uint64(24)  # bits that a short hash leaves out of 64

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

COUNTED = "lang string, k int, phrase string, n long"  # k words
EMITTED = "lang string, phrase string, n long"


class Filter:
    """Set of hashes as bits, two for each; may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.log = bits, (64 * len(bits)).bit_length() - 1

    @staticmethod
    def places(h: np.ndarray, log: int) -> np.ndarray:
        low = np.uint64((1 << log) - 1)
        return np.stack([h & low, (h >> np.uint64(log)) & low])

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, self.log)
        found = (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return found.astype(bool).all(0)


def _started(words: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of a phrase of one word."""
    return mixed(words + lang * GOLDEN)


def _extended(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(h * GOLDEN + words)


def _text_hashes(texts: pa.Array) -> np.ndarray:
    batch = pa.record_batch([texts], names=["t"])
    return np.concatenate([span_hashes(p.data, p.byte_offsets[:-1], p.byte_offsets[1:]) for p in slices(batch, "t", lower=False)] or [np.empty(0, np.uint64)])


def _short(h: np.ndarray) -> np.ndarray:
    return h >> SHORT


def _slots(h: np.ndarray, log: int) -> pa.RecordBatch:
    """(slot, mask): the bits of hashes, by words of a filter of 2**log bits."""
    at = Filter.places(h, log).ravel()
    slot, where = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
    mask = np.zeros(len(slot), np.uint64)
    np.bitwise_or.at(mask, where, np.uint64(1) << (at & np.uint64(63)))
    return pa.record_batch([pa.array(slot), pa.array(mask.view(np.int64))], names=["slot", "mask"])


def _filter_from(slots: DataFrame, log: int) -> Filter:
    found = slots.groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    bits = np.zeros(1 << (log - 6), np.uint64)
    bits[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Filter(bits)


def filter_of(phrases: DataFrame) -> Filter:
    """The filter that holds ``phrases`` (lang, phrase)."""
    log = FILTER_BITS

    def make(batch):
        lang = _text_hashes(batch.column(0))
        for part in slices(batch, "phrase", lower=False):
            words, size = part.hashes(), np.diff(part.offsets)
            first = part.offsets[:-1]
            h = _started(words[first], lang[part.row : part.row + len(part)])
            for k in range(1, int(size.max())):
                more = size > k
                h[more] = _extended(h[more], words[first[more] + k])
            yield _slots(h, log)

    return _filter_from(arrow_map(phrases.select("lang", "phrase"), "slot long, mask long", make), log)


class Pieces:
    """Words of a slice: maximal runs without a gap, in pieces that end at stops and with their text."""

    def __init__(self, part: Slice):
        self.data = part.data
        edges = part.byte_offsets
        stop = _STOP[self.data]
        inside = ~(stop | _GAP[self.data])
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        border = edges[(edges > 0) & (edges < len(self.data))]
        begins[border] |= inside[border]
        finishes[border - 1] |= inside[border - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.text = np.searchsorted(edges, self.starts, "right") - 1
        piece = np.cumsum(stop)[self.starts]
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])  # to the next word
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        self.words = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(self.data[inside]))

    def __len__(self) -> int:
        return len(self.starts)

    def phrases(self, first: np.ndarray, k: int) -> pa.StringArray:
        """Text of the k words from each of ``first`` on, joined by single spaces."""
        word = (first[:, None] + np.arange(k)).ravel()
        widths = self.ends[word] - self.starts[word] + 1
        offsets = np.concatenate([[0], np.cumsum(widths)])
        at = np.arange(offsets[-1]) + np.repeat(self.starts[word] - offsets[:-1], widths)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[offsets[1:] - 1] = 0x20
        stay = np.ones(len(out), bool)
        stay[offsets[k::k] - 1] = False  # no space after the last
        lengths = np.add.reduceat(widths, np.arange(0, len(word), k)) - 1 if len(word) else np.empty(0, int)
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(out[stay]))


def _small_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, Slice]]:
    """(first row, slice) of a batch with about ``PART`` bytes of text each, so that the numbers
    held per word stay few; a longer text is one slice."""
    texts = batch.column(1)
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        to = max(int(np.searchsorted(edges, edges[row] + PART, "right")) - 1, row + 1)
        for part in slices(batch.slice(row, to - row)):
            yield row + part.row, part
        row = to


def _distinct(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number, count) of values below ``bound``, numbered by their order."""
    if bound > 4 * len(values) + 1024:
        _, first, number, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        return first, number, count
    count = np.bincount(values, minlength=bound)
    used = np.flatnonzero(count)
    place = np.empty(bound, np.int64)
    place[values[::-1]] = np.arange(len(values) - 1, -1, -1)
    number = np.cumsum(count > 0) - 1
    return place[used], number[values], count[used]


def counted_phrases(pieces: Pieces, lang: np.ndarray, lang_hash: np.ndarray, filters: list[Filter], eager: bool, most: int):
    """(k, first word of each, hashes, counts): the phrases of a slice that the pass of the last filter counts.

    ``lang`` has a number per text, ``lang_hash`` a hash for each number. Single words are
    reached by the first pass. A phrase is reached by a pass if its parts without the last
    and without the first word both lead on there: they are reached by then and its filter
    holds them, or (``eager``) the last pass itself is the first to reach them.
    """
    if not len(pieces):
        return
    coded = pieces.words.dictionary_encode()
    word, hashes = coded.indices.to_numpy(), _text_hashes(coded.dictionary)
    first, number, count = _distinct(lang[pieces.text] * len(coded.dictionary) + word, len(lang_hash) * len(coded.dictionary))
    last = len(filters) - 1
    single, singles = number, len(first)
    h = _started(hashes[word[first]], lang_hash[lang[pieces.text[first]]])
    if last == 0:
        yield 1, first, h, count
    new = np.zeros(len(first), bool)  # phrases that only the last of several passes reaches
    at = np.arange(len(pieces))  # places of the phrases reached, in order
    for k in range(2, most + 1):
        leads = np.zeros(len(h), np.int8)  # a bit per pass
        for j, f in enumerate(filters):
            leads |= (f.holds(h) & (~new if j < last else True)).astype(np.int8) << np.int8(j)
        if eager:
            leads |= new.astype(np.int8) << np.int8(last)
        both = leads[number[:-1]] & leads[number[1:]]
        follows = np.flatnonzero((both > 0) & (at[1:] == at[:-1] + 1) & pieces.joined[np.minimum(at[:-1] + k - 2, len(pieces) - 2)])
        if not len(follows):
            return
        both, prefix, place = both[follows], number[follows], at[follows]
        some, number, count = _distinct(prefix * singles + single[place + k - 1], int(prefix.max() + 1) * singles)
        h = _extended(h[prefix[some]], hashes[word[place[some] + k - 1]])
        new = both[some] == 1 << last if last else np.zeros(len(some), bool)
        use = new if last else np.ones(len(some), bool)
        yield k, place[some][use], h[use], count[use]
        at = place


def _reached(batch: pa.RecordBatch, known: list[Filter], eager: bool, most: int):
    """(pieces, language code of each text, language names, counted phrases) of every slice of a
    batch (lang, text)."""
    coded = batch.column(0).dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lang_hash = _text_hashes(names)
    for at, part in _small_slices(batch):
        pieces, lang = Pieces(part), code[at : at + len(part)]
        yield pieces, lang, names, counted_phrases(pieces, lang, lang_hash, known, eager, most)
        pa.default_memory_pool().release_unused()


def often_hashed(docs: DataFrame, filters: list[Filter], least: int, most: int = WORDS) -> Filter:
    """The short hashes that the phrases of a pass have ``least`` times or more together."""
    log = FILTER_BITS
    shared = docs.sparkSession.sparkContext.broadcast([f.bits for f in filters])

    def make(batch) -> Iterator[pa.RecordBatch]:
        for _, _, _, told in _reached(batch, [Filter(bits) for bits in shared.value], False, most):
            for _, _, h, count in told:
                yield pa.record_batch([pa.array(_short(h).view(np.int64)), pa.array(count)], names=["h", "n"])

    def bits(batch) -> Iterator[pa.RecordBatch]:
        yield _slots(mixed(batch.column(0).to_numpy().view(np.uint64)), log)

    totals = arrow_map(docs.select("lang", "text"), "h long, n long", make).groupBy("h").agg(F.sum("n").alias("n"))
    return _filter_from(arrow_map(totals.where(F.col("n") >= least).select("h"), "slot long, mask long", bits), log)


def pass_over(
    docs: DataFrame, filters: list[Filter], eager: bool = False, most: int = WORDS, often: Filter | None = None
) -> DataFrame:
    """Exact (lang, k, phrase, n) of all phrases that the pass of the last filter reaches and the
    one before did not; the first pass also has k = 0, the words of each language. With ``often``
    only phrases whose short hash it holds."""
    shared = docs.sparkSession.sparkContext.broadcast([f.bits for f in filters])
    kept = docs.sparkSession.sparkContext.broadcast(None if often is None else often.bits)

    def make(batch) -> Iterator[pa.RecordBatch]:
        known = [Filter(bits) for bits in shared.value]
        held = None if kept.value is None else Filter(kept.value)
        for pieces, lang, names, told in _reached(batch, known, eager, most):

            def rows(of, phrases, count):
                return pa.record_batch([names.take(pa.array(of)), phrases, pa.array(count)], names=["lang", "phrase", "n"])

            if len(known) == 1 and len(pieces):
                total = np.bincount(lang[pieces.text], minlength=len(names))
                yield rows(np.arange(len(names)), pa.array([""] * len(names)), total)
            for k, first, h, count in told:
                if held is not None:
                    use = held.holds(mixed(_short(h)))
                    first, count = first[use], count[use]
                if len(first):
                    yield rows(lang[pieces.text[first]], pieces.phrases(first, k), count)

    found = arrow_map(docs.select("lang", "text"), EMITTED, make).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    return found.select("lang", F.when(F.col("phrase") == "", 0).otherwise(spaces + 1).alias("k"), "phrase", "n")


def frequent_phrases(docs: DataFrame, least: int, proposals: DataFrame | None = None, most: int = WORDS) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of up to ``most`` words found ``least`` times or more,
    and k = 0 for the words of each language; exact whatever is proposed.

    Without proposals every pass finds the phrases one word longer. With proposals, the pass
    that follows failures is eager: a phrase it is the first to reach is extended at once,
    without knowing its count, so that what the failures lead to is counted in that pass.
    """
    spark = docs.sparkSession
    known = proposals if proposals is not None else spark.createDataFrame([], COUNTED).select("lang", "phrase")
    filters, eager, found = [filter_of(known)], False, None
    while True:
        # The border of proposals is nearly all of a corpus; that of other passes is small.
        often = often_hashed(docs, filters, least, most) if proposals is not None and not eager else None
        told = pass_over(docs, filters, eager, most, often)
        new = stage(told.where(F.col("n") >= F.when(F.col("k") == 0, 1).otherwise(least)), "phrases")
        found = new if found is None else found.unionByName(new)
        if eager:
            return found
        extendable = new.where((F.col("k") > 0) & (F.col("k") < most)).select("lang", "phrase")
        failures = stage(extendable.join(known, ["lang", "phrase"], "left_anti"), "failures")
        if failures.isEmpty():
            return found
        known = known.unionByName(failures)
        filters, eager = [filters[-1], filter_of(known)], proposals is not None


def mined(docs: DataFrame, least: int = MIN_COUNT, share: float = SHARE, most: int = WORDS) -> DataFrame:
    """Frequent phrases as ``frequent_phrases`` gives them, proposed by a sample of ``share``. Rows
    are drawn by id and text, so copies of a text are drawn one by one."""
    lang, text = F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    told = docs.select(lang, text)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = stage(docs.where(chance < share).select(lang, text), "sample")
    lowered = max(2, int(least * share * EASE))
    proposals = stage(frequent_phrases(sample, lowered, most=most).where("k > 0").select("lang", "phrase"), "proposals")
    return frequent_phrases(told, least, proposals, most)


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the lowest-scoring cut of each phrase of two words or
    more; products in decimals of up to 38 digits, exact for counts below 10**16."""
    totals = small_table(found.where("k = 0").select("lang", F.col("n").alias("total")))
    parts = found.where("k > 0").select("lang", "phrase", "n")
    cuts = found.where("k > 1").selectExpr("lang", "phrase", "n AS a", "k", "explode(sequence(1, k - 1)) AS cut")
    cuts = cuts.selectExpr("*", "substring_index(phrase, ' ', cut) AS head", "substring_index(phrase, ' ', cut - k) AS tail")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    told = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")

    def exact(name):
        return F.col(name).cast("decimal(16,0)")

    told = told.withColumn("above", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("total"))
    told = told.withColumn("below", exact("l") * exact("r")).withColumn("score", F.expr("above div below"))
    best = told.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("s"))
    return best.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")


def without_parts(candidates: DataFrame, found: DataFrame, percent: int = KEEP_PERCENT) -> DataFrame:
    """``candidates`` (lang, phrase, a) that lie in no longer phrase of ``found`` with ``percent`` of their count."""
    inner = found.where("k > 2").selectExpr("lang", "split(phrase, ' ') AS w", "k", "n")
    inner = inner.selectExpr("lang", "w", "k", "n", "explode(sequence(2, k - 1)) AS size")
    inner = inner.selectExpr("lang", "w", "size", "n", "explode(sequence(1, k - size + 1)) AS at")
    longest = inner.selectExpr("lang", "array_join(slice(w, at, size), ' ') AS phrase", "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    joined = candidates.join(longest, ["lang", "phrase"], "left")
    return joined.where(f"longer IS NULL OR 100 * longer < {int(percent)} * a").drop("longer")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, ranked. A language is ranked in parts first,
    so no task orders all of its phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = parted.where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return first.where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, share: float = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the collocations of ``docs`` (doc_id, text, lang).

    Texts are split at stops, then at spaces and tabs; A-Z are lower-cased. Null texts are
    empty, a null lang is ``und``, repeated rows count each, other columns are ignored; an
    empty table has no rows. Ties: higher count, then the phrase in byte order.
    """
    found = stage(mined(docs, least, share), "frequent")
    return ranked(without_parts(scored(found), found), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
), totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {WORDS + 1}) AS ks(k)),
found AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM places GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}
), cuts AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a, unnest(range(1, k)) AS cut FROM found WHERE k > 1
), scores AS (
  SELECT c.lang, c.phrase, c.k, a, h.f AS l, t.f AS r, n, cut, (1000 * a * n) // (h.f * t.f) AS score
  FROM cuts c JOIN found h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN found t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
  JOIN totals ON totals.lang = c.lang
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM found q WHERE q.lang = b.lang AND q.k > b.k
      AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * q.f >= {KEEP_PERCENT} * b.a)
), ordered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ordered WHERE rank <= {TOP}
"""
