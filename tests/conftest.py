from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("4", "4")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
