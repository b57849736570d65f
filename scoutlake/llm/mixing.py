"""Mixing sources to target weights: capped water-filling and seeded repetitions.

The mix shares the words of all documents among the sources by weight. A source whose
share exceeds the most that its documents may be repeated is clamped there, and what is
over is shared again among the others by weight until no source is above its cap. Every
document of a source is then taken floor(target / size) times, and a seeded part of them
once more, so that the words taken come near the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.llm.words import arrow_map, slices
from scoutlake.session import checked_broadcast, stage

EPOCHS = 3  # most repetitions of a document
CYCLE = 3  # weights 1..CYCLE by the order of the sources
SEED = "mix-1"
LEVEL = 4096  # bins per level of the seeded order


def sizes(docs: DataFrame) -> DataFrame:
    """(row, source, draw, size): each row as a struct, its seeded place and its words."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), draw.alias("draw"))

    def make(batch):
        for part in slices(batch.column(0), lower=False):  # the rows hold the texts, so that none is sent twice
            yield pa.record_batch(
                [
                    *(batch.column(k).slice(part.row, len(part)) for k in range(3)),
                    pa.array(np.diff(part.offsets), pa.int64()),
                ],
                names=["row", "source", "draw", "size"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return arrow_map(rows, f"row {kind}, source string, draw long, size long", make)


def weighted_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight): weights 1, 2, 3, 1, ... in the order of code points, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    key = [F.col("source").isNull(), F.col("source")]
    # The order of all sources without one task for all: sorted ranges, then their offsets.
    ranged = stage(
        per.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sources",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("n"))
    rank = F.col("place") + F.col("n")
    return ranged.join(before, "part").select("source", "source_size", (rank % CYCLE + 1).alias("weight"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: capped water-filling of the whole size. Each round asks for two sums
    and clamps the sources above their cap; the rest share what is left by weight."""
    sources = stage(sources, "weights")
    wide = "decimal(38,0)"
    cap = F.col("source_size").cast(wide) * EPOCHS
    total = int(sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    weight = F.col("weight").cast("decimal(18,0)")
    fixed, weights, free = 0, 0, F.lit(True)
    while True:
        row = sources.agg(
            F.sum(F.when(~free, cap).otherwise(0)).alias("fixed"), F.sum(F.when(free, weight).otherwise(0)).alias("weights")
        ).first()
        new = int(row["fixed"] or 0), int(row["weights"] or 0)
        if new == (fixed, weights) or not new[1]:
            break
        fixed, weights = new
        left = F.lit(total - fixed).cast("decimal(19,0)") * weight
        free = left <= cap * weights
    if not weights:  # no source at all
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn(
        "target", F.when(free, left.cast("double") / F.lit(float(weights))).otherwise(cap.cast("double"))
    )


def thresholds(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """(s, source_size, target, whole, below): every document of source ``s`` is taken
    ``whole`` times, and once more where its place is under ``below``.

    The limit comes from sums per bin of the seeded order, first coarse, then fine within
    the one coarse bin that it falls into, so a source of any size needs no order of its own
    rows. The place across the limit counts where that brings the words nearer.
    """
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    plan = planned.withColumn("whole", F.floor(ratio).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "s")
    rests = plan.select("s", "rest")
    high, low = F.floor(F.col("draw") / LEVEL), F.col("draw") % LEVEL
    coarse = _edge(sized.select("source", "size", high.alias("bin"), F.lit(0).alias("base")), rests)
    coarse = coarse.select("s", F.col("bin").alias("high"), F.col("before").alias("base"))
    inside = sized.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (high == F.col("high")))
    fine = _edge(inside.select("source", "size", low.alias("bin"), "base", "high"), rests, "high")
    nearer = 2 * (F.col("rest") - F.col("before")) >= F.col("words")
    below = F.col("high") * LEVEL + F.col("bin") + F.when(nearer, 1).otherwise(0)
    limits = fine.select(F.col("s").alias("t"), below.alias("below"))
    return plan.join(limits, F.col("s").eqNullSafe(F.col("t")), "left").select(
        "s", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")
    )


def _edge(rows: DataFrame, rests: DataFrame, *more: str) -> DataFrame:
    """The bin of each source in which its rest ends, with its words and those before it."""
    per = rows.groupBy("source", "bin", "base", *more).agg(F.sum("size").alias("words")).where("words > 0")
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # at most LEVEL bins
    per = per.withColumn("before", F.col("base") + running - F.col("words"))
    return per.join(rests, F.col("source").eqNullSafe(F.col("s"))).where("before < rest and before + words >= rest")


def mix(docs: DataFrame) -> DataFrame:
    """(row, size, source_size, target, repeats) for each row of ``docs`` (doc_id, text,
    source), row being the row as a struct, so no column clashes.

    A size is the number of words of the whole text, 0 for null and empty ones. Null sources
    are one source, the last. Rows that repeat a doc_id share one place in the seeded order
    and are taken alike; null ids share one place too. Reruns agree. An empty table gives
    no row.
    """
    measured = sizes(docs.select("doc_id", "source", "text")).select("source", "draw", "size")
    measured = stage(measured, "sizes")
    plan = stage(thresholds(measured, targets(weighted_sources(measured))), "plan")
    joined = sizes(docs).join(checked_broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    repeats = F.col("whole") + F.when(F.col("draw") < F.col("below"), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", repeats.alias("repeats"))


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row: the words that the mix takes."""
    mixed = mix(docs.select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The documents in the mix, all columns, with ``repeats``, the times each is taken; a
    column of ``docs`` with that name, in any case, gives way."""
    mixed = mix(docs).where("repeats > 0")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "repeats"]
    return mixed.select(*kept, F.col("repeats").alias("repeats"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS r FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM f),
k AS (SELECT fixed AS kf, weights AS kw FROM c WHERE (total - fixed) * weight <= cap * weights ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (total - kf) * weight <= cap * kw
    THEN ((total - kf) * weight)::DOUBLE / kw::DOUBLE ELSE cap::DOUBLE END AS target FROM c, k),
p AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole,
    target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM t),
b AS (SELECT source, draw, sum(size) AS words FROM d GROUP BY ALL HAVING sum(size) > 0),
cum AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY draw) - words AS before FROM b),
edge AS (SELECT p.source, draw + CASE WHEN 2 * (rest - before) >= words THEN 1 ELSE 0 END AS below
    FROM cum JOIN p ON cum.source IS NOT DISTINCT FROM p.source WHERE before < rest AND before + words >= rest)
SELECT d.doc_id, d.size::BIGINT AS size, p.source_size::BIGINT AS source_size, p.target,
    (d.size * (p.whole + CASE WHEN d.draw < coalesce(e.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN edge e ON d.source IS NOT DISTINCT FROM e.source
"""
