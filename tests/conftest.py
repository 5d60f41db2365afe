from __future__ import annotations

import os
import sys
from datetime import UTC, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from loglattice.schemas import EVENT_COLUMNS, LOG_EVENTS  # noqa: E402
from loglattice.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
EVENT_SCHEMA = T.StructType([LOG_EVENTS[c] for c in EVENT_COLUMNS])


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from keyword rows; unnamed fields get a valid default."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "id": i, "timestamp": datetime(2025, 12, 1, 12, 0, tzinfo=UTC), "source": "journald",
                "service": "test.service", "host": "test-node", "level": "INFO", "message": "Test log message",
            }
            base.update(row)
            full.append(tuple(base.get(c) for c in EVENT_COLUMNS))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return build


@pytest.fixture
def evaluate(spark):
    """Apply a column function to a list of strings."""

    def run(fn, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]

    return run


def plan_of(df) -> str:
    """The physical plan with all details."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
