"""Greedy spacing chains: keep the first time of a key, then always the first later
time at least (or more than) ``gap`` after the one kept last.

Incident anchors, alert cool-down, baseline ticks and timeline samples are all this
fold. Keys with few distinct times are folded in one JVM aggregate. A key beyond
``limit`` is never gathered into one group: its time axis is cut into blocks of
``gap`` seconds, of which a chain can enter each at most once, and blocks are grouped
``fan_out`` at a time into a tree. Going up, every group reduces to "entered at time
e, the chain leaves at time x" for the few possible entries e (those in its first
block, and the first one after it). Going down, the known entry of a group yields the
entries of its parts. Each group sees at most ``fan_out`` blocks of candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutlake.session import checked_broadcast, stage


def spaced_chain(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    gap: float,
    inclusive: bool,
    limit: int = 200_000,
    fan_out: int = 8,
) -> DataFrame:
    """(keys, node) with the kept times. ``inclusive``: exactly ``gap`` is far enough."""
    times = stage(rows.select(*keys, F.col(ts).alias("node")).distinct(), "chain-times")
    hot = times.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    if hot.limit(1).count() == 0:
        return _fold(times, keys, gap, inclusive)
    # At most rows / limit keys can be hot; the check keeps the broadcast honest.
    marked = checked_broadcast(hot)
    cold = times.join(marked, keys, "left_anti")
    heavy = times.join(marked, keys, "left_semi")
    return _fold(cold, keys, gap, inclusive).unionByName(
        _tree(heavy, keys, gap, inclusive, fan_out)
    )


def _far(delta, gap: float, inclusive: bool):
    return delta >= gap if inclusive else delta > gap


def _fold(times: DataFrame, keys: list[str], gap: float, inclusive: bool) -> DataFrame:
    def step(kept, t):
        last = F.try_element_at(kept, F.lit(-1))
        take = last.isNull() | _far(t - last, gap, inclusive)
        return F.when(take, F.concat(kept, F.array(t))).otherwise(kept)

    ordered = times.groupBy(*keys).agg(F.sort_array(F.collect_list("node")).alias("t"))
    start = F.array().cast("array<double>")
    return ordered.select(*keys, F.explode(F.aggregate("t", start, step)).alias("node"))


def _next_index(times: np.ndarray, last: np.ndarray, gap: float, inclusive: bool) -> np.ndarray:
    """Index of the first time far enough after each ``last``; len(times) if none."""
    at = np.searchsorted(times, last + gap, side="left")
    padded = np.append(times, np.inf)
    # The sum above may round; settle by the difference, as the rule is stated.
    before = np.maximum(at - 1, 0)
    at = np.where((at > 0) & _far(times[before] - last, gap, inclusive), before, at)
    short = ~_far(padded[at] - last, gap, inclusive)
    return np.where(short, at + 1, at)


def _tree(
    times: DataFrame, keys: list[str], gap: float, inclusive: bool, fan_out: int
) -> DataFrame:
    span = times.agg(F.min("node"), F.max("node")).first()
    if span[0] is None:
        return times
    origin = int(np.floor(span[0] / gap))
    blocks = int(np.floor(span[1] / gap)) - origin + 1
    depth = 0
    while fan_out ** (depth + 1) < blocks:
        depth += 1
    kinds = {f.name: f for f in times.schema.fields}
    key_fields = [kinds[k] for k in keys]

    def group_no(level: int):
        block = F.floor(F.col("node") / F.lit(gap)).cast("bigint") - F.lit(origin)
        return F.floor(block / F.lit(fan_out ** (level + 1))).cast("bigint")

    up_schema = T.StructType(
        key_fields + [T.StructField("node", T.DoubleType()), T.StructField("leave", T.DoubleType())]
    )

    def compose(level: int):
        width = fan_out ** (level + 1)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node", ignore_index=True)
            enter, leave = pdf["node"].to_numpy(), pdf["leave"].to_numpy()
            first_block_end = (origin + int(pdf["part"].iloc[0]) * width + 1) * gap
            early = int(np.searchsorted(enter, first_block_end, side="left"))
            now = leave[: min(early + 1, len(enter))].copy()
            while True:
                at = _next_index(enter, now, gap, inclusive)
                moving = at < len(enter)
                if not moving.any():
                    break
                now[moving] = leave[at[moving]]
            out = pdf[keys].iloc[: len(now)].copy()
            out["node"] = enter[: len(now)]
            out["leave"] = now
            return out

        return run

    def walk(known: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if known.empty or parts.empty:
            return parts[[*keys, "node"]].iloc[:0]
        parts = parts.sort_values("node", ignore_index=True)
        enter, leave = parts["node"].to_numpy(), parts["leave"].to_numpy()
        at = int(np.searchsorted(enter, known["node"].iloc[0], side="left"))
        picked = []
        while at < len(enter):
            picked.append(at)
            at = int(_next_index(enter, leave[at : at + 1], gap, inclusive)[0])
        return parts[[*keys, "node"]].iloc[picked]

    levels = [times.withColumn("leave", F.col("node"))]
    for level in range(depth):
        grouped = levels[-1].withColumn("part", group_no(level)).groupBy(*keys, "part")
        levels.append(stage(grouped.applyInPandas(compose(level), up_schema), f"chain-up{level}"))

    node_schema = T.StructType(key_fields + [T.StructField("node", T.DoubleType())])
    known = times.groupBy(*keys).agg(F.min("node").alias("node"))
    for level in range(depth, -1, -1):
        left = known.withColumn("part", group_no(level)).groupBy(*keys, "part")
        right = levels[level].withColumn("part", group_no(level)).groupBy(*keys, "part")
        known = left.cogroup(right).applyInPandas(walk, node_schema)
    return known


def with_neighbours(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``before`` and ``after``: the chain's previous and next node of the key.

    A chain has at most one node per ``gap`` seconds, so the window is bounded by the
    time span, not by the number of rows.
    """
    order = Window.partitionBy(*keys).orderBy("node")
    return nodes.withColumns(
        {"before": F.lag("node").over(order), "after": F.lead("node").over(order)}
    )


def latest_node(rows: DataFrame, nodes: DataFrame, keys: list[str], ts: str, gap: float) -> DataFrame:
    """Joins every row of the chained table with the last chain node not after it.

    A row lies within ``gap`` of its node, so the node is in the row's own block or the
    one before: one equi-join on (keys, block), spread over time for heavy keys. Extra
    columns of ``nodes`` come along.
    """
    extra = [c for c in nodes.columns if c not in keys]
    block = F.floor(F.col("node") / F.lit(gap)).cast("bigint")
    seen = nodes.select(
        *keys, F.struct(*extra).alias("n"), F.explode(F.array(block, block + 1)).alias("_b"),
        block.alias("_home"),
    )
    near = seen.groupBy(*keys, "_b").agg(
        F.max(F.when(F.col("_home") == F.col("_b"), F.col("n"))).alias("_own"),
        F.max(F.when(F.col("_home") < F.col("_b"), F.col("n"))).alias("_prior"),
    )
    placed = rows.withColumn("_b", F.floor(F.col(ts) / F.lit(gap)).cast("bigint"))
    chosen = F.when(F.col("_own.node") <= F.col(ts), F.col("_own")).otherwise(F.col("_prior"))
    return (
        placed.join(near, [*keys, "_b"])
        .withColumn("_n", chosen)
        .select(*rows.columns, *[F.col(f"_n.{c}").alias(c) for c in extra])
    )
