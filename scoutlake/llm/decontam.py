"""Benchmark decontamination: SimHash of item-sized windows, DataFrame expressions only.

A window has as many words as the item it may repeat. A window that shares no five-word
shingle with any item cannot be similar to one, so only places that do are fingerprinted,
each aligned with the items' places. Fingerprints are compared by a multi-index: 64 bits
in ``len(BLOCKS)`` blocks, and every item stored under all block values within ``FLIPS``
bits. Two fingerprints within ``len(BLOCKS) * (FLIPS + 1) - 1`` bits agree on some block up
to ``FLIPS`` bits, so all pairs in that radius meet. Candidates are then verified exactly:
the weight of a shingle is how often it occurs, and sum(min) / sum(max) must reach 0.8.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.session import checked_broadcast, stage

SHINGLE = 5
PERCENT = 80
BLOCKS = (13, 13, 13, 13, 12)
FLIPS = 3
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1  # 19 of 64; similarity 0.8 lies near 10 with deviation 3
BROADCAST_SHINGLES = 500_000
BROADCAST_IDS = 1_000_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def word_array(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")


def shingle_hash(words: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def shingle_texts(words: str) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE))
    )


def fingerprint(shingles: str) -> Column:
    """Bit b is the majority of bit b over the shingles' hashes, each occurrence counted."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def bit(b: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.shiftleft(F.when(2 * ones > F.size(shingles), F.lit(1)).otherwise(F.lit(0)).cast("long"), b)

    return reduce(Column.bitwiseOR, [bit(b) for b in range(64)])


def _block_values(mark: str) -> list[Column]:
    values, low = [], 0
    for width in BLOCKS:
        values.append(F.shiftrightunsigned(mark, low).bitwiseAND(F.lit((1 << width) - 1)))
        low += width
    return values


def _exploded_blocks(df: DataFrame, flips: int) -> DataFrame:
    """One row per block and value within ``flips`` bits of it."""
    entries = []
    for k, value in enumerate(_block_values("mark")):
        masks = [m for m in range(1 << BLOCKS[k]) if m.bit_count() <= flips]
        near = F.transform(F.array(*map(F.lit, masks)), lambda m, v=value: v.bitwiseXOR(m.cast("long")))
        entries.append(F.transform(near, lambda v, k=k: F.struct(F.lit(k).alias("block"), v.alias("value"))))
    return df.withColumn("entry", F.explode(F.flatten(F.array(*entries)))).select("*", "entry.*").drop("entry")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, shingles) of items with five words or more."""
    words = benchmark.select("item_id", word_array().alias("words")).where(F.size("words") >= SHINGLE)
    return words.select("item_id", F.size("words").alias("length"), shingle_texts("words").alias("shingles"))


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, length, start, shingles): the item-sized windows that share a shingle with an
    item of that length, at the place where that shingle stands alike in both; clipped to
    the text, and the whole text where it has fewer words than the item."""
    grams = items.select(
        "length", F.posexplode("shingles").alias("place", "gram")
    ).select(F.xxhash64(*[F.get(F.split("gram", " "), F.lit(k)) for k in range(SHINGLE)]).alias("h"), "length", "place").distinct()
    grams = stage(grams, "grams")
    small = grams.count() <= BROADCAST_SHINGLES
    words = docs.select("doc_id", word_array().alias("words")).where(F.size("words") >= SHINGLE)
    places = words.select(
        "doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("i")
    ).withColumn("h", shingle_hash("words", F.col("i")))
    hits = places.join(F.broadcast(grams) if small else grams, "h")
    start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("place"), F.size("words") - F.col("length")))
    return (
        hits.select("doc_id", "length", start.alias("start"), F.concat_ws(" ", F.slice("words", start + 1, F.col("length"))).alias("window"))
        .distinct()
        .withColumn("words", F.split("window", " "))
        .select("doc_id", "length", "start", shingle_texts("words").alias("shingles"))
    )


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two shingle arrays, the weight being the number of occurrences."""

    def times(column, s):
        return F.size(F.filter(column, lambda x: x == s))

    both = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s))
    )
    return both / (F.size(a) + F.size(b) - both)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, distance): per document and item that it repeats,
    the best window (first word counted from 0, the earliest of equals).

    Texts of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) are taken whole, as
    lower-cased runs of letters and digits. Null, empty and shorter texts than five words
    match nothing. Repeated rows give one result per pair of ids; a null id is an id like
    any other. Other columns are ignored.
    """
    items = stage(benchmark_items(benchmark).withColumn("mark", fingerprint("shingles")), "items")
    marked = stage(windows(docs, items).withColumn("mark", fingerprint("shingles")), "windows")
    index = _exploded_blocks(items.select("item_id", "length", "mark"), FLIPS)
    probes = _exploded_blocks(marked.select("doc_id", "length", "start", "mark"), 0)
    met = (
        probes.join(index.withColumnRenamed("mark", "other"), ["length", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("mark").bitwiseXOR(F.col("other"))))
        .where(F.col("distance") <= RADIUS)
        .select("doc_id", "length", "start", "item_id", "distance", "mark").distinct()
    )
    on = (
        F.col("m.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("m.length") == F.col("w.length"))
        & (F.col("m.start") == F.col("w.start")) & (F.col("m.mark") == F.col("w.mark"))
    )
    near = (
        met.alias("m").join(marked.alias("w"), on).select("m.*", F.col("w.shingles").alias("mine"))
        .join(items.select("item_id", "length", "mark", F.col("shingles").alias("theirs")).withColumnRenamed("mark", "other"), ["item_id", "length"])
        .where(F.bit_count(F.col("mark").bitwiseXOR(F.col("other"))) == F.col("distance"))
        .withColumn("similarity", similarity("mine", "theirs"))
        .where(F.col("similarity") * 100 >= PERCENT)
    )
    best = F.max_by(F.struct("similarity", "start", "distance"), F.struct("similarity", -F.col("start"))).alias("best")
    return near.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text repeats no item."""
    found = stage(leaks(docs, benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    # Ids go to the texts, not texts to the ids, which would shuffle the whole corpus.
    found = checked_broadcast(found, BROADCAST_IDS)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked"]), "left_anti")


SQL = rf"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS length, w FROM i WHERE len(w) >= 5),
ig AS (SELECT item_id, length, unnest(range(0, length - 4)) AS place, w FROM items),
ishingle AS (SELECT item_id, length, place, array_to_string(w[place + 1:place + 5], ' ') AS g FROM ig),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
dd AS (SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) >= 5),
dg AS (SELECT doc_id, n, w, unnest(range(0, n - 4)) AS pos FROM dd),
dshingle AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS g FROM dg),
win AS (SELECT DISTINCT doc_id, length, greatest(0, least(pos - place, n - length)) AS start
    FROM dshingle JOIN (SELECT DISTINCT length, place, g FROM ishingle) USING (g)),
ws AS (SELECT doc_id, length, start, g, count(*) AS c FROM win JOIN dshingle USING (doc_id)
    WHERE pos >= start AND pos <= start + length - 5 GROUP BY ALL),
wn AS (SELECT doc_id, length, start, sum(c) AS total FROM ws GROUP BY ALL),
ic AS (SELECT item_id, length, g, count(*) AS c FROM ishingle GROUP BY ALL),
both_sides AS (SELECT doc_id, item_id, length, start, sum(least(ws.c, ic.c)) AS x
    FROM ws JOIN ic USING (length, g) GROUP BY ALL),
sims AS (SELECT doc_id, item_id, start, x::DOUBLE / (total + length - 4 - x)::DOUBLE AS similarity
    FROM both_sides JOIN wn USING (doc_id, length, start))
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, (similarity, -start))::INTEGER AS start
FROM sims WHERE similarity * 100 >= 80 GROUP BY ALL
"""
