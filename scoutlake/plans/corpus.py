"""A corpus of captures as one labelled feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.operators.hosts import FLOW_IDS, feature_table
from scoutlake.operators.labels import label_from_log
from scoutlake.params import DEFAULT, Params
from scoutlake.plans.features import staged_flows
from scoutlake.schemas import FEATURES_34
from scoutlake.session import stage
from scoutlake.sources.captures import read_captures


def corpus_features(
    spark: SparkSession, path: str, log: DataFrame, dataset: str = "lab",
    max_packets: int | None = None, params: Params = DEFAULT,
) -> DataFrame:
    """34 features of every flow of every capture, tagged with file, label, attack type
    and data set. Captures stay apart: flows, windows and hosts are keyed by capture."""
    packets = stage(read_captures(spark, path, max_packets=max_packets), "packets")
    table = feature_table(packets, staged_flows(packets, params), wide=True, params=params)
    tagged = table.select(
        *FLOW_IDS, *FEATURES_34, F.col("start_s").alias("timestamp"), F.col("capture").alias("pcap_filename"),
        F.lit(dataset).alias("dataset"),
    )
    return label_from_log(tagged, log)
