"""N-gram Jaccard join: grouped prefix join with exact components.

Documents with the same shingle set form a class, which its least doc_id represents.
Classes are ordered by one global token order (rare shingles first, the most frequent
ones last); two sets with Jaccard t or more share a shingle among their first
``n - ceil(t n) + 1``. Classes with the same prefix and size are one group, so a group has
one posting per prefix shingle. Group pairs that meet in a posting list pass a length and
a position filter, are expanded to their classes and verified on whole sets.

Long posting lists are never expanded into all pairs at once. Every list is first compared
with one pivot, the member with the fewest rare shingles (an original among its copies);
what is linked with the pivot is one component. Pairs inside a component need no further
comparison, and only pairs of different components are enumerated, after more pivots where
a list still has many. The result is exact for every choice of pivots and of the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.llm.graph import components
from scoutlake.llm.words import Lookup, arrow_map, frequent, list_array, shingle_sets, slices
from scoutlake.session import checked_broadcast, stage

HEAVY = 1 << 18  # at most so many frequent shingles, which the order puts last; their hashes are broadcast
BROADCAST_IDS = 1_000_000
BINS = 256  # of a set's shingles by hash; they bound what two sets can share
BIN_SHIFT = np.uint64(56)
PIVOT_ROUNDS = 3
CROWD = 256  # open pairs per posting above which lists get another pivot first


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, key) per document row, and (shingle, n) for shingles that a batch of
    documents holds more than once: those that may be frequent. One pass, staged."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("shingle", pa.int64())])

    def make(batch):
        for part in slices(batch):
            sets = shingle_sets(part, size)
            yield pa.record_batch(
                [
                    batch.column(0).slice(part.row, len(part)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.int64()),
                ],
                schema=schema,
            )
            met = np.sort(np.concatenate(sets))
            heads = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]])) if len(met) else met
            times = np.diff(np.append(heads, len(met)).astype(np.int64))
            often = times > 1
            if often.any():
                yield pa.record_batch(
                    [
                        pa.nulls(int(often.sum()), pa.int64()),
                        pa.array(times[often]),
                        pa.nulls(int(often.sum()), pa.binary()),
                        pa.array(met[heads[often]].view(np.int64)),
                    ],
                    schema=schema,
                )

    kinds = "doc_id long, n long, key binary, shingle long"
    return stage(arrow_map(docs.select("doc_id", "text"), kinds, make), "sets")


def prefix_table(docs: DataFrame, size: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(doc_id, n, grp, rare, prefix, bins): a set's size, the hash of prefix and size, how many
    of its shingles are not frequent, the prefix in the global order, and the number of its
    shingles in each of ``BINS`` bins."""
    ranked = heavy.view(np.uint64)  # by falling frequency
    places = np.argsort(ranked)
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(ranked[places]), -places))

    def make(batch):
        lookup, ranks = shared.value  # the least frequent of the frequent ones come first
        ids = batch.column(0)
        for part in slices(batch):
            sets = shingle_sets(part, size)
            rows, heads, rare, groups, bins = [], [], [], [], []
            for k, s in enumerate(sets):
                if not len(s):
                    continue
                at = lookup(s)
                late = at >= 0
                last = s[late][np.argsort(ranks[at[late]])]
                head = np.concatenate([s[~late], last])[: prefix_length(len(s), percent)]
                rows.append(k)
                heads.append(head)
                rare.append(len(s) - len(last))
                bins.append(np.bincount((s >> BIN_SHIFT).astype(np.int64), minlength=BINS).astype(np.int32))
                groups.append(xxhash.xxh3_64_intdigest(head.tobytes() + len(s).to_bytes(8, "little")))
            if rows:
                yield pa.record_batch(
                    [
                        ids.slice(part.row, len(part)).take(pa.array(rows)).cast(pa.int64()),
                        pa.array([len(sets[k]) for k in rows], pa.int64()),
                        pa.array(np.array(groups, np.uint64).view(np.int64)),
                        pa.array(rare, pa.int64()),
                        list_array(heads),
                        list_array(bins, np.int32),
                    ],
                    names=["doc_id", "n", "grp", "rare", "prefix", "bins"],
                )

    return arrow_map(
        docs.select("doc_id", "text"), "doc_id long, n long, grp long, rare long, prefix array<long>, bins array<int>", make
    )


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    def make(batch):
        for part in slices(batch):
            yield pa.record_batch(
                [batch.column(0).slice(part.row, len(part)).cast(pa.int64()), list_array(shingle_sets(part, size))],
                names=["doc_id", "items"],
            )

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, items array<long>", make)


def _near(percent: int):
    """What two sets need for a link, by their sizes and the places of a shared shingle: sizes
    within the threshold, and from there on as many shingles left in both as must be shared.
    The first shared shingle of any link meets it."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (100 * small >= percent * large) & ((100 + percent) * left >= percent * (small + large))


def verified(docs: DataFrame, bins: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets link.

    Two sets share at most the sum over bins of the smaller count; pairs that cannot reach
    the threshold by that bound go first, at a few bytes each. The others are decided by
    whole sets from whole texts.
    """
    pairs = stage(pairs.distinct(), "pairs")
    few = bins.join(checked_broadcast(_ids(pairs), BROADCAST_IDS), "doc_id", "left_semi")
    left = few.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bins").alias("x"))
    right = few.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("y"))
    most = F.aggregate(F.zip_with("x", "y", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
    able = pairs.join(left, "a").join(right, "b").where((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    pairs = stage(able.select("a", "b").distinct(), "able")
    texts = docs.join(checked_broadcast(_ids(pairs), BROADCAST_IDS), "doc_id", "left_semi")
    sets = stage(whole_sets(texts, size), "whole")
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return stage(
        pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b").distinct(),
        "links",
    )


def _ids(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    return both.distinct()


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) whole texts; a set holds the distinct ``size``-word
    shingles, or one shingle of all words of a shorter text. Two documents link when
    100 * intersection >= percent * union; component_id is the least doc_id reachable.
    A null or empty text has an empty set and links with nothing, its component is its own
    id. A null doc_id takes no part and has a null component. Rows that repeat a doc_id
    are one document whose links are those of all its rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    table = set_table(docs, size)
    rows = table.where("key is not null").select("doc_id", "n", "key")
    met = table.where("key is null").groupBy("shingle").agg(F.sum("n").alias("times"))
    often = frequent(met, "times", HEAVY).toPandas().sort_values(["times", "shingle"], ascending=[False, True])
    heavy = often["shingle"].to_numpy(np.int64)
    named = rows.where("doc_id is not null and n > 0")
    classes = named.groupBy("key").agg(F.min("doc_id").alias("cls"))
    members = stage(named.join(classes, "key").select("doc_id", "cls").distinct(), "classes")
    copies = members.where("doc_id <> cls")
    # A class is compared by its least document; a repeated id may be least in one of two.
    spare = copies.select("doc_id").distinct().join(members.where("doc_id = cls"), "doc_id", "left_anti")
    alone = docs.where("doc_id is not null").join(checked_broadcast(spare, BROADCAST_IDS), "doc_id", "left_anti")
    prefixes = stage(prefix_table(alone, size, percent, heavy), "prefixes")
    groups = _groups(prefixes)
    edges = copies.select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
    found = _components(docs, prefixes.select("doc_id", "n", "bins"), groups, _postings(prefixes, groups), edges, size, percent)
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _groups(prefixes: DataFrame) -> DataFrame:
    """(doc_id, grp, lead, n, rare): the rows of a prefix group and its least document. A
    repeated id may lead one group and follow in another."""
    leads = prefixes.groupBy("grp").agg(F.min("doc_id").alias("lead"))
    rows = prefixes.select("doc_id", "grp", "n", "rare").join(leads, "grp")
    return stage(rows.select("doc_id", "grp", "lead", "n", "rare").distinct(), "groups")


def _postings(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """(tok, lead, pos, n, rare) of groups, for shingles in the prefix of several groups.

    Frequent shingles are known and bounded in number, they pass at once and are dealt
    over many keys; any other list is short, so its window may see it whole.
    """
    others = groups.where("doc_id <> lead").select("doc_id", "grp")
    first = prefixes.join(checked_broadcast(others, BROADCAST_IDS), ["doc_id", "grp"], "left_anti")
    lists = Window.partitionBy("tok", "salt").orderBy("lead")
    met = (
        first.select(F.col("doc_id").alias("lead"), "grp", "rare", F.posexplode("prefix").alias("pos", "tok"))
        .withColumn("often", F.col("pos") >= F.col("rare"))  # the order puts them last
        .withColumn("salt", F.when(F.col("often"), F.xxhash64("lead")).otherwise(0))
        .withColumn("after", F.lead("lead").over(lists))
        .withColumn("before", F.lag("lead").over(lists))
        .where("often or after is not null or before is not null")
        .select("tok", "lead", "grp", "pos")
    )
    facts = groups.where("doc_id = lead").select("lead", "grp", "n", "rare")
    return stage(met.join(facts, ["lead", "grp"]).drop("grp"), "postings")


def _components(docs, bins, groups, met, edges, size, percent) -> DataFrame:
    """Links by pivots, then by all pairs still open, and the components they make."""
    member = groups.select(F.col("lead").alias("a"), F.col("doc_id").alias("doc_a"))
    inner = groups.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    open_lists, links, known = met, edges, None
    for turn in range(PIVOT_ROUNDS):
        pivots = stage(_pivots(open_lists, turn), "pivots")
        pairs = (
            open_lists.alias("a").join(pivots.alias("b"), F.col("a.tok") == F.col("b.tok"))
            .where(F.col("a.lead") != F.col("b.lead")).where(_near(percent))
            .select(F.col("a.lead").alias("a"), F.col("b.lead").alias("b")).distinct()
            .join(member, "a").select(F.col("doc_a").alias("a"), "b")
        )
        links = links.unionByName(verified(docs, bins, pairs if turn else pairs.unionByName(inner), size, percent))
        known = stage(components(links), "components")
        open_lists = _open(met, _group_components(groups, known))
        if not _crowded(open_lists):
            break
    own = groups.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "lead", "doc_id", F.coalesce("component", "doc_id").alias("comp")
    )
    across = (
        open_lists.alias("a").join(open_lists.alias("b"), F.col("a.tok") == F.col("b.tok"))
        .where(F.col("a.lead") < F.col("b.lead"))
        .where((F.col("a.low") != F.col("b.high")) | (F.col("a.high") != F.col("b.low"))).where(_near(percent))
        .select(F.col("a.lead").alias("a"), F.col("b.lead").alias("b")).distinct()
    )
    split = own.groupBy("lead").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l <> h")
    pairs = (
        across.unionByName(split.select(F.col("lead").alias("a"), F.col("lead").alias("b")))
        .join(own.select(F.col("lead").alias("a"), F.col("doc_id").alias("doc_a"), F.col("comp").alias("comp_a")), "a")
        .join(own.select(F.col("lead").alias("b"), F.col("doc_id").alias("doc_b"), F.col("comp").alias("comp_b")), "b")
        .where("comp_a <> comp_b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))
    )
    return components(links.unionByName(verified(docs, bins, pairs, size, percent)))


def _pivots(lists: DataFrame, turn: int) -> DataFrame:
    """One group per list: the one with the fewest rare shingles, later outside the largest
    component of the list. Minima and counts are reduced before the shuffle."""
    if turn:
        per = lists.groupBy("tok", "low").count()
        big = per.groupBy("tok").agg(F.max(F.struct("count", "low"))["low"].alias("big"))
        # Another turn must not meet the same pivot again, so the order changes with it.
        lists = lists.join(big, "tok").where("low <> big").withColumn("rare", F.xxhash64("lead", F.lit(turn)))
    best = lists.groupBy("tok").agg(F.min(F.struct("rare", "lead", "n", "pos")).alias("p"))
    return best.select("tok", "p.lead", "p.n", "p.pos")


def _group_components(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(lead, low, high): the least and greatest component among the members of a group."""
    own = groups.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    comp = F.coalesce("component", "doc_id")
    return own.groupBy("lead").agg(F.min(comp).alias("low"), F.max(comp).alias("high"))


def _open(met: DataFrame, of_group: DataFrame) -> DataFrame:
    """Postings of lists that hold more than one component."""
    told = met.join(of_group, "lead")
    several = told.groupBy("tok").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h")
    return stage(told.join(several, "tok", "left_semi"), "open")


def _crowded(lists: DataFrame) -> bool:
    """Whether more pairs are open than ``CROWD`` per posting."""
    per = lists.groupBy("tok", "low").count().groupBy("tok")
    pairs = per.agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.col("count")).alias("s"))
    row = pairs.agg(F.sum("t").alias("t"), F.sum(F.expr("t * t - s")).alias("open")).first()
    return row["t"] is not None and row["open"] > 2 * CROWD * row["t"]
