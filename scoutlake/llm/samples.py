"""Bounded samples of labelled rows, drawn on the labels before any text is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(rows, shares): rows (text, label) of about ``per_class`` documents of each label 0 and 1,
    and the share of each label that was drawn.

    ``learn`` is a condition on doc_id. Labels are drawn by a hash of id and label, so the draw
    is the same on every run. The drawn ids, a few thousand, are broadcast to the scan of the
    documents: texts are not shuffled but for those drawn. Equal texts of one label count
    once. At most twice the number asked for comes back.
    """
    told = labels.select("doc_id", F.col(label).cast("long").alias("label")).where("label in (0, 1) AND doc_id IS NOT NULL").where(learn).distinct()
    counts = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, per_class / n) for k, n in counts.items()}
    if not shares:
        return docs.select("text", F.lit(0).cast("long").alias("label")).limit(0), {}
    share = F.lit(0.0)
    for value, part in shares.items():
        share = F.when(F.col("label") == value, part).otherwise(share)
    chance = F.pmod(F.xxhash64("doc_id", "label"), F.lit(1 << 30)) / float(1 << 30)
    most = 2 * per_class * len(shares)
    drawn = told.where(chance < share).limit(most)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "label")
    return rows.distinct().limit(most), shares
