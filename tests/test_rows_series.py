import random
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom import operators as op
from tests import whole_series as whole
from meterloom.functions.blocks import duration_us, pack, time_block
from tests.conftest import START


def test_keys_and_values(series):
    readings = series([1, 2])
    keyed = op.assign_key(readings, "k", 5.0).collect()
    assert [(r.key, r.value) for r in keyed] == [("k", 5.0)] * 2
    assert op.with_value(readings, F.col("value") + 1).agg(F.sum("value")).first()[0] == 5.0
    assert op.filter_key(series({"a": [1], "b": [2]}), "b").count() == 1
    assert op.union_series(readings, readings, readings).count() == 6
    assert op.dedupe(readings.unionByName(readings)).agg(F.max("value")).first()[0] == 4.0


def test_calendar(series):
    row = op.calendar_expand(series([1.0], start=START + timedelta(days=40, minutes=90))).first()
    assert (row.year, row.month, row.day, row.dow, row.hour, row.minute) == (2024, 1, 10, 7, 1, 30)


def test_day_windows_include_both_ends(series):
    readings = series([1.0] * 30, minutes=1440)  # days 1..30
    pick = lambda **o: sorted(
        (r.week, r.ts.day) for r in op.select_days(readings, origin="2024-01-01", **o).collect()
    )
    assert pick(start_day=2, n_days=2) == [(0, 2), (0, 3), (0, 4)]
    assert pick(start_day=2, n_days=1, weeks=2) == [(0, 2), (0, 3), (1, 9), (1, 10)]
    assert pick(start_day=2, n_days=1, weeks=2, last_only=True) == [(1, 9), (1, 10)]
    overlap = pick(start_day=1, n_days=7, weeks=2)
    assert len(overlap) == 16 and (0, 8) in overlap and (1, 8) in overlap


def test_hourly_sum(series):
    pairs = op.hourly_sum(series([1, 2, 3, 4])).orderBy("hour").collect()
    assert [(r.date, r.dow, r.hour, r.value) for r in pairs] == [
        (date(2024, 1, 1), 2, 1, 3.0),
        (date(2024, 1, 1), 2, 2, 7.0),
    ]
    stamped_at_end = series([1, 2, 3, 4], start=START + timedelta(minutes=30))
    ends = op.hourly_sum(stamped_at_end, slot_label="end").orderBy("hour").collect()
    assert [(r.hour, r.value) for r in ends] == [(1, 3.0), (2, 7.0)]


def test_difference_by_hand(series, column):
    d = op.difference(series([1, 4, 9, 16]))
    assert column(d, "diff") == [None, 3.0, 5.0, 7.0]
    assert column(op.integrate(d), "integrated") == [1.0, 4.0, 9.0, 16.0]
    assert column(op.difference(series([1, 4, 9, 16]), times=2), "diff") == [None, None, 2.0, 2.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 30), st.integers(31, 120), st.integers(0, 10**6))
def test_integrate_inverts_difference(series, column, lag, n, seed):
    rng = random.Random(seed)
    x = [rng.uniform(-10, 10) for _ in range(n)]
    d = op.difference(series(x), lag=lag, block="5 hours")
    assert column(op.integrate(d, lag=lag, width=3), "integrated") == pytest.approx(x)


def test_two_levels_invert(series, column):
    rng = random.Random(8)
    x = [rng.random() for _ in range(100)]
    seasonal = op.difference(series(x), lag=24).withColumnRenamed("diff", "z").drop("i")
    rest = seasonal.where("z IS NOT NULL")
    inner = op.difference(rest, lag=1, value="z")
    z = op.integrate(inner, lag=1, initial="z").select("key", "ts", "integrated")
    both = op.difference(series(x), lag=24).drop("diff").join(z, ["key", "ts"], "left")
    assert column(op.integrate(both, lag=24, diff="integrated", out="x"), "x") == pytest.approx(x)


def test_centering_and_covariance(series, column):
    rng = random.Random(9)
    x = np.array([rng.gauss(3, 2) for _ in range(300)])
    readings = series({"m": list(x)})
    assert column(op.center(readings, block="1 day"), "centered") == pytest.approx(list(x - x.mean()))
    got = op.autocovariance(readings, 4, block="7 hours").first()
    assert got.n == 300
    assert got.acov == pytest.approx(list(whole.autocovariances(x - x.mean(), 4)))


def test_stats_and_rmse(series):
    x = [1.0, 2.0, 4.0]
    row = op.series_stats(series(x)).first()
    assert (row.n, row.min, row.mean) == (3, 1.0, pytest.approx(7 / 3))
    assert row.std == pytest.approx(np.std(x)) and row.variance == pytest.approx(np.var(x, ddof=1))
    error = op.rmse(series(x), series([1.0, 0.0, 0.0])).first()
    assert (error.n, error.rmse) == (3, pytest.approx((20 / 3) ** 0.5))


def test_a_dominant_series_stays_in_bounded_blocks(series):
    readings = series({"hot": [1.0] * 2000, "a": [1.0] * 20, "b": [2.0] * 20})
    blocks = pack(readings, ["key"], ["ts"], time_block("ts", "1 day"))
    assert blocks.packed.agg(F.max(F.size("_rows"))).first()[0] <= 48
    assert blocks.rows().agg(F.count("*"), F.max("i")).first()[:] == (2040, 1999)


def test_durations():
    assert duration_us("30 minutes") == 1_800_000_000 == duration_us(timedelta(minutes=30))
    with pytest.raises(ValueError):
        duration_us("soon")
