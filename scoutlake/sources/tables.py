"""Tables in and out: CSV, parquet, JSON lines, metric documents, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutlake.schemas import METRIC_NAMES, RUN_METRICS, UNSW


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_unsw(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 49-column flow CSV, all text; numbers are parsed by the mapping."""
    return spark.read.schema(UNSW).csv(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """One folder per strategy and subset, so a reader of one subset lists only it."""
    splits.write.mode("overwrite").partitionBy("strategy", "subset").parquet(path)


def read_split(spark: SparkSession, path: str, strategy: str, subset: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.filter((F.col("strategy") == strategy) & (F.col("subset") == subset))


def flattened(df: DataFrame, separators: dict[str, str] | None = None) -> DataFrame:
    """Array columns as text; techniques by comma, everything else by semicolon."""
    separators = separators or {"mitre_mappings": ", "}
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.concat_ws(separators.get(c, "; "), c) for c in arrays})


def write_csv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-run metric documents in long form; summary files in the folder are left out."""
    docs = spark.read.schema(RUN_METRICS).option("multiLine", True).json(path)
    name = F.col("_metadata.file_name")
    runs = docs.filter(~name.contains("statistical") & ~name.contains("aggregate"))
    wide = runs.select("strategy", "model", "seed", *[F.col(f"test_metrics.{m}").alias(m) for m in METRIC_NAMES])
    return wide.unpivot(["strategy", "model", "seed"], METRIC_NAMES, "metric", "value").filter("value IS NOT NULL")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One document per run, named by the run."""
    inner = F.struct(*[F.col(m) for m in METRIC_NAMES if m in metrics.columns])
    runs = metrics.select(
        F.concat_ws("_", "strategy", "model", F.concat(F.lit("seed"), "seed")).alias("run"),
        "strategy", "model", "seed", inner.alias("test_metrics"),
    )
    runs.write.mode("overwrite").partitionBy("run").json(path)


def report_document(table: DataFrame, keys: list[str]) -> DataFrame:
    """A small keyed table as one JSON document: key -> its columns."""
    values = [c for c in table.columns if c not in keys]
    entry = F.struct(F.concat_ws("/", *keys).alias("key"), F.struct(*values).alias("value"))
    return table.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("doc")).select(
        F.to_json("doc").alias("document")
    )


def write_report(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def netflow_slice(df: DataFrame, n: int, labels: list[str], label: str = "Attack") -> DataFrame:
    """The first ``n`` rows of a data set, then those with the wanted labels."""
    return df.limit(n).filter(F.col(label).isin(labels))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
