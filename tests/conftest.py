import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.session import local_session  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "seriesloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build (key, ts, y) from lists of values per key, one value per hour."""

    def build(values: dict, step=timedelta(hours=1), start=START, schema="key string, ts timestamp_ntz, y double"):
        rows = [(k, start + i * step, v) for k, vs in values.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def table():
    """Rows of a frame as a list of tuples, in order."""

    def read(df, *order):
        return [tuple(r) for r in df.orderBy(*order).collect()]

    return read
