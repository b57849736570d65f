"""Packets to labelled feature tables, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scoutlake.operators.flows import assemble_flows
from scoutlake.operators.hosts import feature_table
from scoutlake.operators.labels import label_flows
from scoutlake.params import DEFAULT, Params
from scoutlake.session import stage


def staged_flows(packets: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The flow table, written once: four consumers of a feature table read it."""
    return stage(assemble_flows(packets, chunk_rows=params.chunk_rows), "flows")


def features(packets: DataFrame, wide: bool = False, params: Params = DEFAULT) -> DataFrame:
    return feature_table(packets, staged_flows(packets, params), wide, params)


def labelled_features(
    packets: DataFrame, scanners: DataFrame | None = None, params: Params = DEFAULT
) -> DataFrame:
    return label_flows(features(packets, params=params), scanners)
