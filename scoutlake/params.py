"""Operator parameters. One frozen dataclass, passed explicitly; no global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Flow assembly and host windows.
    flow_timeout_s: float = 60.0
    host_window_s: int = 30
    window_sizes_s: tuple[int, ...] = (5, 15, 30, 60, 120)
    min_packets_alert: int = 1
    min_packets_incident: int = 2
    # Rate floors: the 20-column schema and the 34-column schema differ.
    rate_floor_20: float = 0.1
    rate_floor_34: float = 0.0001
    # Incidents and alert cool-down.
    incident_span_s: float = 60.0
    cooldown_s: float = 60.0
    # Behavioural profiles.
    retention_s: float = 3600.0
    baseline_interval_s: float = 60.0
    baseline_min_ticks: int = 5
    drift_window_s: float = 300.0
    running_mean_cap: int = 1000
    correlation_threshold: float = 0.6
    # Model work.
    seeds: tuple[int, ...] = (42, 7, 13, 99, 2024)
    test_size: float = 0.2
    # Physical layout. chunk_rows bounds how many consecutive packets of one key
    # a single ordered task may see; it never changes a result.
    chunk_rows: int = 1 << 20
    # Most rows a dimension may have and still be broadcast.
    broadcast_rows: int = 200_000


DEFAULT = Params()
