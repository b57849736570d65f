"""Data-set audit: sizes, nulls, duplicates, distributions, coverage, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.session import checked_broadcast


def _missing(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)

    def one(name: str) -> Column:
        null = F.col(f"`{name}`").isNull()
        if kinds[name] in ("double", "float"):
            null = null | F.isnan(F.col(f"`{name}`"))
        return null.cast("bigint")

    return sum(one(c) for c in df.columns)


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and repeated full rows (all but the first)."""
    groups = df.withColumn("_nulls", _missing(df)).groupBy(*[f"`{c}`" for c in df.columns])
    per_row = groups.agg(F.count(F.lit(1)).alias("c"), F.sum("_nulls").alias("m"))
    return per_row.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def coverage(df: DataFrame, column: str, words: dict[str, list[str]]) -> DataFrame:
    """One flag per entry: does any value contain one of its words?"""
    text = F.lower(F.col(column))

    def any_of(ws: list[str]) -> Column:
        hit = F.lit(False)
        for w in ws:
            hit = hit | text.contains(w)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    return df.agg(*[any_of(ws).alias(name) for name, ws in words.items()])


# Words that show a scan class is present.
SCAN_WORDS = {
    "has_syn_scan": ["syn"],
    "has_fin_scan": ["fin"],
    "has_null_scan": ["null"],
    "has_xmas_scan": ["xmas"],
    "has_udp_scan": ["udp"],
    "has_sweep": ["sweep", "distributed"],
    "has_port_scan": ["portscan", "port scan"],
    "has_reconnaissance": ["reconnaissance"],
}


def category_count(df: DataFrame, column: str, word: str) -> DataFrame:
    match = F.lower(F.trim(F.col(column))) == F.lit(word.strip().lower())
    return df.agg(F.count_if(match).alias("rows"))


def preflight(found: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """Expected against found rows. Both have ``key`` and ``rows``."""
    want = expected.select(key, F.col("rows").cast("bigint").alias("expected_rows"))
    have = found.select(key, F.col("rows").alias("found_rows"))
    return (
        want.join(have, key, "left")
        .withColumn("found_rows", F.coalesce("found_rows", F.lit(0)))
        .withColumn("pass", F.col("found_rows") == F.col("expected_rows"))
    )


def duplicate_balance(df: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Duplicate rate and class balance before and after dropping repeated vectors.

    A repeated vector keeps the label of its first row (smallest ``row_id``).
    """
    vectors = df.groupBy(*names).agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col(label) == 1).alias("r"),
        F.min_by(label, "row_id").alias("first_label"),
    )
    rows = F.sum("c")
    return vectors.agg(
        rows.alias("original_rows"),
        F.count(F.lit(1)).alias("dedup_rows"),
        (F.lit(100.0) * (rows - F.count(F.lit(1))) / rows).alias("duplicate_rate_pct"),
        F.sum("r").alias("recon_original"),
        (rows - F.sum("r")).alias("benign_original"),
        F.count_if(F.col("first_label") == 1).alias("recon_dedup"),
        F.count_if(F.col("first_label") == 0).alias("benign_dedup"),
    )


def expectations(df: DataFrame, key: str, rows: str) -> DataFrame:
    return checked_broadcast(df.select(F.col(key).alias("name"), F.col(rows).alias("rows")))
