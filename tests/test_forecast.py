import json
import random

import numpy as np
import pytest

from meterloom import operators as op
from meterloom import schemas
from meterloom.functions import arma
from meterloom.functions.arma import Order
from tests import whole_series as whole
from meterloom.operators.forecast import _forecast_general

GOLDEN = [1, 2, 3, 4, 5, 4, 3, 2, 1, 2]


def forecast(readings, **options):
    return op.forecast_arima(readings, keys=["key"], value="value", **options).orderBy("key", "step")


def test_golden_series(series):
    rows = forecast(series(GOLDEN)).collect()
    assert [r.step for r in rows] == list(range(10))
    assert rows[0].yhat == pytest.approx(2.67807026, abs=1e-8)
    assert [r.yhat for r in rows[1:]] == pytest.approx([2.7] * 9)
    model = op.forecast_models(series(GOLDEN), keys=["key"], value="value").first()
    assert model.theta == pytest.approx(0.818085905463, abs=1e-11)


def test_constant_series(series):
    rows = forecast(series([3.0] * 10)).collect()
    assert {r.yhat for r in rows} == {3.0} and {r.lo for r in rows} == {3.0}
    assert op.forecast_models(series([3.0] * 10), keys=["key"], value="value").first().theta == 0


def test_short_series_have_a_status(series):
    both = series({"short": [1, 2, 3, 4, 5, 6], "long": GOLDEN})
    rows = forecast(both).collect()
    assert [(r.yhat, r.status) for r in rows if r.key == "short"] == [(None, "too_short")] * 6
    assert {r.status for r in rows if r.key == "long"} == {"ok"}
    scores = {r.key: r for r in op.backtest(both, keys=["key"], value="value").collect()}
    assert (scores["short"].status, scores["short"].rmse, scores["short"].n) == ("too_short", None, 6)
    general = forecast(both, order=Order(1, 0, 0, 0, 0, 0, 0)).collect()
    assert {r.status for r in general if r.key == "short"} == {"too_short"}


@pytest.mark.parametrize("block", ["365 days", "2 hours"])
def test_sums_agree_with_recursion(series, block):
    rng = random.Random(11)
    data = {}
    for n in (7, 8, 10, 13, 14, 50, 200, 333):
        noise = [rng.gauss(0, 1) for _ in range(n + 1)]
        data[f"ma{n}"] = [40 + noise[i + 1] + 0.6 * noise[i] for i in range(n)]
        data[f"walk{n}"] = list(np.cumsum(noise[:n]))
        data[f"spiky{n}"] = [rng.random() ** 8 * 1000 for _ in range(n)]
        data[f"zeros{n}"] = [0.0] * (n - 1) + [5.0]
    models = op.forecast_models(series(data), keys=["key"], value="value", block=block)
    scores = op.backtest(series(data), keys=["key"], value="value", block=block)
    rmse = {r.key: r.rmse for r in scores.collect()}
    rows = models.collect()
    assert len(rows) == len(data)
    for r in rows:
        x = np.array(data[r.key])
        model = whole.fit(x, Order(), 1)
        assert r.theta == pytest.approx(model.coef[0], rel=1e-7, abs=1e-9), r.key
        assert r.mu + r.theta * r.error == pytest.approx(model.forecast(1)[0], rel=1e-7, abs=1e-7)
        expected, tail = whole.back_test(x, Order())
        assert (r.n_test, rmse[r.key]) == (tail, pytest.approx(expected, rel=1e-6, abs=1e-7)), r.key


def test_intervals_and_shift(series):
    rows = forecast(series(GOLDEN)).collect()
    theta, rmse = 0.818085905463, rows[0].rmse
    z = 1.959963984540054
    assert rows[0].hi - rows[0].yhat == pytest.approx(z * rmse)
    assert rows[1].hi - rows[1].yhat == pytest.approx(z * rmse * (1 + theta**2) ** 0.5)
    shifted = forecast(series(GOLDEN), psi_shift=1).collect()
    assert shifted[1].yhat - shifted[1].lo == pytest.approx(z * rmse)
    assert shifted[2].yhat - shifted[2].lo == pytest.approx(z * rmse * (1 + theta**2) ** 0.5)
    # The path of any lag set gives the same numbers for this order.
    grouped = _forecast_general(
        series(GOLDEN), Order(), ["key"], "ts", "value", "in_place", None, "30 minutes", 1, "1 hour"
    ).orderBy("step").collect()
    for a, b in zip(shifted, grouped):
        assert (a.step, a.ts, a.status) == (b.step, b.ts, b.status)
        assert (a.yhat, a.lo, a.hi) == pytest.approx((b.yhat, b.lo, b.hi))


def test_log_record(series):
    log = json.loads(forecast(series(GOLDEN)).first().log)
    assert log == {
        "params": "p= 0, d= 0, q= 1, P= 1, D= 1, Q= 0, m= 0",
        "forecast_size": 10,
        "input_size": 10,
    }


def test_future_alignment(series):
    readings = series(GOLDEN)
    last = max(r.ts for r in readings.collect())
    rows = forecast(readings, align="future", steps=3).collect()
    assert [(r.ts - last).total_seconds() / 60 for r in rows] == [30, 60, 90]
    assert rows[0].yhat == pytest.approx(2.67807026, abs=1e-8)
    with pytest.raises(ValueError):
        forecast(readings, align="future")


def test_lag_sets():
    assert Order(1, 0, 1, 1, 0, 2, 12).ar == [1, 12, 13]
    assert Order(1, 0, 1, 1, 0, 2, 12).ma == [1, 12, 13, 24, 25]
    assert (Order().ar, Order().ma, Order().lost) == ([], [1], 0)
    assert Order(0, 1, 0, 0, 2, 0, 4).lost == 9
    assert len(op.order_grid()) == 24


def test_limited_solve():
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    assert arma.solve_limited(a, np.array([1.0, 2.0])) == pytest.approx(np.linalg.solve(a, [1, 2]))
    # A pivot of 1e-6 beside one of 1 is raised to 1/100.
    assert arma.solve_limited(np.diag([1.0, 1e-6]), np.array([1.0, 1.0])) == pytest.approx([1, 100])
    assert arma.solve_limited(np.zeros((1, 1)), np.array([0.0])) == pytest.approx([0.0])


def test_differenced_forecasts_continue_the_pattern(series):
    pattern = [1.0, 5.0, 2.0, 8.0]
    x = [pattern[i % 4] + 10 * (i // 4) for i in range(60)]
    order = Order(0, 0, 0, 0, 1, 0, 4)
    rows = forecast(series(x), order=order, align="future", steps=8).collect()
    assert [r.yhat for r in rows] == pytest.approx(
        [pattern[i % 4] + 10 * (i // 4) for i in range(60, 68)]
    )
    trend = forecast(series([3.0 * i for i in range(40)]), order=Order(0, 1, 0, 0, 0, 0, 0), align="future", steps=3)
    assert [r.yhat for r in trend.collect()] == pytest.approx([120, 123, 126])
    both = Order(0, 1, 0, 0, 1, 0, 4)
    rows = forecast(series(x), order=both, align="future", steps=8).collect()
    assert [r.yhat for r in rows] == pytest.approx(
        [pattern[i % 4] + 10 * (i // 4) for i in range(60, 68)]
    )


def test_autoregression(series):
    rng = random.Random(21)
    x = [0.0, 0.0]
    for _ in range(4000):
        x.append(0.5 * x[-1] - 0.3 * x[-2] + rng.gauss(0, 1))
    row = op.fit_ar(series(x), 2).first()
    assert row.phi == pytest.approx([0.5, -0.3], abs=0.05)
    centred = np.array(x) - np.mean(x)
    assert row.phi == pytest.approx(list(arma.yule_walker(whole.autocovariances(centred, 2))))
    fitted = forecast(series(x), order=Order(2, 0, 0, 0, 0, 0, 0), align="future", steps=1).first()
    assert fitted.status == "ok"


def test_weights_of_an_autoregression():
    got = whole.spread(Order(1, 0, 0, 0, 0, 0, 0), np.array([0.5]), 4)
    assert got == pytest.approx(np.sqrt(np.cumsum([1, 0.25, 0.0625, 0.015625])))


def test_residuals_across_blocks(series, column):
    rng = random.Random(31)
    x = [rng.gauss(0, 1) for _ in range(150)]
    ar, ma = {1: 0.3, 2: 0.1}, {1: 0.4, 3: -0.2}
    expected = whole.errors(np.array(x), [1, 2], [1, 3], np.array([0.3, 0.1, 0.4, -0.2]))
    for block in ("365 days", "1 hour", "7 hours"):
        got = column(op.arma_residuals(series(x), ar, ma, block=block), "residual")
        assert got == pytest.approx(list(expected))
    only_ar = column(op.arma_residuals(series(x), ar, block="5 hours"), "residual")
    assert only_ar == pytest.approx(list(whole.errors(np.array(x), [1, 2], [], np.array([0.3, 0.1]))))


def test_order_search(series):
    rng = random.Random(41)
    season = [10 + 5 * np.sin(2 * np.pi * h / 24) for h in range(24)]
    x = [season[i % 24] + rng.gauss(0, 0.1) for i in range(24 * 14)]
    best = op.auto_arima(series({"m": x, "tiny": x[:20]}, minutes=60)).orderBy("key", "step").collect()
    found = [r for r in best if r.key == "m"]
    assert len(found) == 48 and found[0].m == 24 and found[0].seasonal_d == 1
    truth = [season[i % 24] for i in range(24 * 14, 24 * 16)]
    assert max(abs(r.yhat - t) for r, t in zip(found, truth)) < 0.6
    assert all(r.lo95 < r.lo80 < r.yhat < r.hi80 < r.hi95 for r in found)
    assert {r.status for r in best if r.key == "tiny"} == {"too_short"}


def test_add_peaks(spark, series):
    f = spark.createDataFrame(
        [(r.key, r.key, r.ts, 10.0) for r in series({"a": [0, 0], "b": [0, 0]}).collect()],
        "key string, profile_key string, ts timestamp, yhat double",
    )
    p = spark.createDataFrame(
        [(r.key, r.key, r.ts, 2, r.value) for r in series({"a": [1, 2], "b": [3, 4]}).collect()],
        "key string, profile_key string, ts timestamp, dow int, peak double",
    )
    own = op.add_peaks(f, p)
    assert sorted((r.key, r.value) for r in own.collect()) == [("a", 11.0), ("a", 12.0), ("b", 13.0), ("b", 14.0)]
    combos = spark.createDataFrame([("a", "a", "b", "b")], schemas.COMBOS)
    crossed = op.add_peaks(f, p, combos)
    assert sorted((r.f_key, r.key, r.value) for r in crossed.collect()) == [("a", "b", 13.0), ("a", "b", 14.0)]
