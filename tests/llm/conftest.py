from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from texts import EDGE, SCHEMA, SF  # noqa: E402

from scoutlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "llm", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
