"""Nulls, short series and caller's names: nothing is lost and nothing counts as zero."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import sources

START = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, value double"


def rows(spark, values, key="m"):
    return spark.createDataFrame([(key, START + timedelta(minutes=30 * i), v) for i, v in enumerate(values)], SCHEMA)


def test_center_leaves_nulls_out(spark):
    got = op.center(rows(spark, [1.0, None, 3.0])).orderBy("ts").collect()
    assert [r["mean"] for r in got] == [2.0] * 3
    assert [r["centered"] for r in got] == [-1.0, None, 1.0]


def test_autocovariance_leaves_nulls_out(spark):
    got = op.autocovariance(rows(spark, [1.0, None, 3.0, 5.0]), 1).first()
    assert got["n"] == 3
    assert got["acov"] == pytest.approx([8 / 3, 0.0])


def test_series_of_nulls(spark):
    got = op.autocovariance(rows(spark, [None, None]), 1).first()
    assert got["n"] == 0 and got["acov"] == [None, None]


def test_add_peaks_keeps_series_without_forecast(spark):
    forecast = spark.createDataFrame(
        [("a", "a", START, 1.0), ("b", "b", START, None)], "key string, profile_key string, ts timestamp, yhat double"
    )
    peaks = spark.createDataFrame(
        [("a", "a", START, 2, 0.5), ("b", "b", START, 2, 0.5)],
        "key string, profile_key string, ts timestamp, dow int, peak double",
    )
    got = {r["key"]: r["value"] for r in op.add_peaks(forecast, peaks).collect()}
    assert got == {"a": 1.5, "b": None}


def test_gap_fill_keeps_names(spark):
    readings = rows(spark, [1.0, 2.0]).withColumnsRenamed({"ts": "time", "value": "kwh"})
    got = sources.gap_fill(readings, ts="time", value="kwh")
    assert got.columns == ["key", "time", "kwh"]
    assert got.agg(F.sum("kwh")).first()[0] == 3.0
