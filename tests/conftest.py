from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "factloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one text."""

    def run(text, build):
        df = spark.createDataFrame([(text,)], "c string")
        value = df.select(build("c").alias("v")).first()["v"]
        return tuple(value) if hasattr(value, "asDict") else value

    return run
