from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scoutlake.schemas import PACKET  # noqa: E402
from scoutlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture
def packets(spark):
    """Packet table from (ts, src, sport, dst, dport, proto, size, flags) rows."""

    def build(rows, capture="t.pcap"):
        full = [
            (capture, i, float(ts), src, dst, sport, dport, proto, size, flags)
            for i, (ts, src, sport, dst, dport, proto, size, flags) in enumerate(rows)
        ]
        return spark.createDataFrame(full, PACKET)

    return build
