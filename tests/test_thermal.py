import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import plans, schemas, sinks, sources


@pytest.fixture
def weather(spark):
    def make(meters):
        rows = [
            (meter, date(2013, 1, 1) + timedelta(days=d), hour, float(r), float(t))
            for (meter, hour), days in meters.items()
            for d, (r, t) in enumerate(days)
        ]
        return spark.createDataFrame(rows, schemas.WEATHER)

    return make


def days(seed, n=60):
    rng = random.Random(seed)
    return [(rng.uniform(0, 2), rng.uniform(-10, 35)) for _ in range(n)]


def design(values):
    x, y = [], []
    for i in range(3, len(values)):
        t = values[i][1]
        lags = [values[i - k][0] for k in (1, 2, 3)]
        x.append([1.0, *lags, max(t - 20, 0), max(16 - t, 0), max(5 - t, 0)])
        y.append(values[i][0])
    return np.array(x), np.array(y)


def test_regression_matches_least_squares(weather):
    data = {(1, 0): days(1), (1, 7): days(2), (2, 0): days(3, 400)}
    features = op.lag_features(weather(data))
    assert features.count() == 57 + 57 + 397
    for row in op.fit_thermal_ar(features).collect():
        x, y = design(data[row.meter_id, row.hour])
        assert row.status == "ok" and row.n == len(y)
        assert row.beta == pytest.approx(list(np.linalg.lstsq(x, y, rcond=None)[0]), abs=1e-9)


def test_short_and_singular_groups_give_zeros(weather):
    steady = [(random.Random(4).random() + k % 5, 10.0) for k in range(40)]
    data = {(1, 0): days(5, 9), (1, 1): days(6, 10), (2, 0): steady}
    got = {(r.meter_id, r.hour): r for r in op.fit_thermal_ar(op.lag_features(weather(data))).collect()}
    assert got[1, 0].status == "short" and got[1, 1].status == "ok"
    assert got[2, 0].status == "singular" and set(got[2, 0].beta) == {0.0}


def test_lags_are_rows_not_days_and_ties_break_by_reading(spark):
    rows = [
        (1, date(2013, 1, d), 0, float(r), 10.0)
        for d, r in [(1, 1), (5, 2), (5, 1.5), (9, 3), (20, 4)]
    ]
    features = op.lag_features(spark.createDataFrame(rows, schemas.WEATHER)).orderBy("date")
    assert [(r.reading, r.lag1, r.lag2, r.lag3) for r in features.collect()] == [
        (3.0, 2.0, 1.5, 1.0),
        (4.0, 3.0, 2.0, 1.5),
    ]


def test_residual_and_profile(spark, weather):
    hours = weather({(1, 0): [(5.0, 22.0), (7.0, 0.0)], (1, 3): [(1.0, 18.0)]})
    models = spark.createDataFrame(
        [(1, h, [9.0, 9.0, 9.0, 9.0, 0.5, 0.25, 0.1], "ok") for h in (0, 3)], schemas.MODELS
    )
    residual = op.activity_residual(hours, models)
    got = {(r.hour, r.reading): r.activity for r in residual.collect()}
    assert got == pytest.approx({(0, 5.0): 4.0, (0, 7.0): 7.0 - 4.0 - 0.5, (3, 1.0): 1.0})
    row = op.activity_profile(residual, as_arrays=True).first()
    assert row.mean[0] == pytest.approx(3.25) and row.std[0] == pytest.approx(0.75)
    assert row.mean[3] == 1.0 and row.std[3] == 0.0
    assert len(row.mean) == 24 and row.mean[1] == 0.0


def test_training_and_text_round_trip(spark, weather, tmp_path):
    hours = weather({(m, h): days(m * 24 + h, 30) for m in (1, 2) for h in range(24)})
    trained = plans.train_activity(hours)
    path = str(tmp_path / "activity")
    sinks.write_activity(trained, path)
    back = sources.read_activity(spark, path).orderBy("meter_id").collect()
    assert [tuple(r) for r in back] == [
        tuple(r) for r in trained.select("meter_id", "mean", "std").orderBy("meter_id").collect()
    ]


def test_gram(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)], "key string, x double, y double")
    row = op.gram(df, ["key"], ["x", "y"]).first()
    assert (row.g_x_x, row.g_x_y, row.g_y_y) == (10.0, 14.0, 20.0)
    assert op.gram(df, ["key"], ["x"]).columns == ["key", "g_x_x"]
    assert df.select(F.sum("x")).first()[0] == 4.0
