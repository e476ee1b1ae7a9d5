from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from meterloom import schemas  # noqa: E402
from meterloom.session import configure  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def series(spark):
    """Readings from values per key, one per half hour; None leaves a gap."""

    def make(values, minutes=30, start=START):
        if not isinstance(values, dict):
            values = {"m": values}
        rows = [
            (key, start + timedelta(minutes=minutes * i), float(v))
            for key, vs in values.items()
            for i, v in enumerate(vs)
            if v is not None
        ]
        return spark.createDataFrame(rows, schemas.READINGS)

    return make


@pytest.fixture
def column():
    """Values of a column in time order."""

    def get(df, name, order="ts"):
        return [row[name] for row in df.orderBy(order).collect()]

    return get
