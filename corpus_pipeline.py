"""Corpus preparation in stages, each written as Parquet and read again by the next.

    language ID -> n-gram near-duplicates -> benchmark decontamination -> secret scans -> mixing

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
the columns of ``documents``; the last adds ``repeats``, the times a document is taken.
Null ids are documents of their own for every stage but the duplicates', which keeps them;
rows that repeat a doc_id are one document there, of which the row with the least text
(then the least as JSON; null first) stays. Columns of any name beside those of
``documents`` pass through; one named ``repeats`` gives way to that of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import decontam, langid, mixing, ngram_join, secrets
from scoutlake.session import checked_broadcast, stage

# Near duplicates in the pipeline: five words, similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough certainty."""
    return langid.accepted(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    found = stage(ngram_join.ngram_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT), "duplicates")
    judged = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("of"), F.count("*").alias("n"))
    judged = stage(judged.where("doc_id <> of or n > 1"), "judged")
    # Ids go to the texts, not texts to the ids, which would shuffle the whole corpus twice.
    other = checked_broadcast(judged.select("doc_id"), ngram_join.BROADCAST_IDS)
    twice = checked_broadcast(judged.where("doc_id = of").select("doc_id"), ngram_join.BROADCAST_IDS)
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    once = rows.join(other, "doc_id", "left_anti")
    again = rows.join(twice, "doc_id", "left_semi")
    first = again.groupBy("doc_id").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row"))
    return once.unionByName(first).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the times each is taken."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
]
# A trained language model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
