"""Offline capture analysis: packets to scored flows, threat reports and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scoutlake.operators.detect import score_by_rules
from scoutlake.operators.flows import at_least
from scoutlake.operators.threat import (
    incident_anchors,
    incident_documents,
    incident_evidence,
    incidents,
    threat_reports,
)
from scoutlake.params import DEFAULT, Params
from scoutlake.plans.features import features
from scoutlake.session import stage


def reports(packets: DataFrame, min_packets: int = 1, params: Params = DEFAULT) -> DataFrame:
    """Threat report per flow, scored by the rules."""
    wide = features(packets, wide=True, params=params)
    return threat_reports(at_least(score_by_rules(wide), min_packets))


def anchored_reports(packets: DataFrame, min_packets: int | None = None, params: Params = DEFAULT) -> DataFrame:
    """Reports with the start of their incident, written once for the tables made of them.
    ``min_packets`` 2 leaves one-packet probes out, 1 keeps them."""
    least = params.min_packets_incident if min_packets is None else min_packets
    staged = stage(reports(packets, least, params), "reports")
    return stage(incident_anchors(staged, params.incident_span_s), "anchored")


def incident_table(
    packets: DataFrame, min_packets: int | None = None, params: Params = DEFAULT
) -> DataFrame:
    """Incidents of a capture, one row each."""
    return incidents(anchored_reports(packets, min_packets, params))


def incident_records(
    packets: DataFrame, min_packets: int | None = None, params: Params = DEFAULT, shown: int = 1000
) -> DataFrame:
    """Incidents as nested records with up to ``shown`` evidence texts, for the JSON sink."""
    anchored = anchored_reports(packets, min_packets, params)
    return incident_documents(incidents(anchored), incident_evidence(anchored), shown)
