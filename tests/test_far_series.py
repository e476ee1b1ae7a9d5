"""Differences at far lags, repeated integration and nulls in running totals."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom.functions.blocks import running_total
from meterloom.operators import series as module


def rows(spark, data):
    cells = [(k, i, v) for k, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(cells, "key string, i long, value double")


@pytest.mark.parametrize("times", [1, 2, 3])
@pytest.mark.parametrize("width", [4, 1000])
def test_repeated_totals(spark, times, width):
    rng = random.Random(times)
    x = [None if rng.random() < 0.1 else rng.uniform(-5, 5) for _ in range(90)]
    expected = np.array([0.0 if v is None else v for v in x])
    for _ in range(times):
        expected = np.cumsum(expected)
    got = running_total(rows(spark, {"a": x, "b": [None, 1.0]}), ["key"], "i", "value", "t", width, times).collect()
    mine = {r.i: r.t for r in got if r.key == "a"}
    assert [mine[i] for i in range(90)] == [None if v is None else pytest.approx(expected[i]) for i, v in enumerate(x)]
    assert sorted((r.i, r.t) for r in got if r.key == "b") == [(0, None), (1, 1.0)]


def test_totals_carry_past_a_null(spark):
    x = [1.0, None] * 8
    got = running_total(rows(spark, {"a": x}), ["key"], "i", "value", "t", 3).orderBy("i").collect()
    assert got[-2].t == 8 and got[-1].t is None


@pytest.mark.parametrize("lag, times", [(1, 1), (1, 2), (3, 2), (2, 3), (7, 1)])
@pytest.mark.parametrize("near", [0, 48])
def test_integration_undoes_differences(series, column, monkeypatch, lag, times, near):
    monkeypatch.setattr(module, "NEAR", near)
    x = [random.Random(i).uniform(0, 9) for i in range(130)]
    differenced = op.difference(series(x), lag, times, block="9 hours")
    first = F.when(F.col("i") < lag * times, F.col("value"))
    kept = differenced.withColumn("known", first)
    back = op.integrate(kept, lag, initial="known", width=5, times=times)
    assert column(back, "integrated") == pytest.approx(x)
    expected = np.array(x)
    for _ in range(times):
        expected = expected[lag:] - expected[:-lag]
    assert column(differenced, "diff")[lag * times :] == pytest.approx(list(expected))


def test_far_and_near_differences_agree_on_nulls(spark, series, monkeypatch):
    table = series([float(i * i % 17) for i in range(100)])
    table = table.withColumn("value", F.when(F.minute("ts") + F.hour("ts") != 5, F.col("value")))
    table = table.withColumn("row", F.lit("kept"))
    near = op.difference(table, 5).orderBy("i").collect()
    monkeypatch.setattr(module, "NEAR", 0)
    far = op.difference(table, 5).orderBy("i").collect()
    assert near == far and sum(r.diff is None for r in far) > 5
