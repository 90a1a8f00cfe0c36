"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from cytolith.session import local_session

    session = local_session(4, "3g", **{"spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "3"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
