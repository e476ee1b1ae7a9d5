"""Orders of any lag set as block sums, against the models of a whole series in memory."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom.functions.arma import Order
from meterloom.operators import forecast_lags as lags
from tests import whole_series as whole

ORDERS = [
    Order(2, 0, 1, 0, 0, 0, 0),
    Order(1, 0, 1, 0, 1, 1, 6),
    Order(0, 1, 2, 1, 0, 0, 6),
    Order(1, 1, 0, 0, 1, 0, 6),
    Order(0, 0, 0, 0, 1, 0, 6),
]


def made(n, seed, period=6):
    rng = random.Random(seed)
    season = [rng.uniform(0, 10) for _ in range(period)]
    noise = [rng.gauss(0, 1) for _ in range(n + 1)]
    level = 20.0
    x = []
    for i in range(n):
        level += rng.gauss(0, 0.2)
        x.append(level + season[i % period] + noise[i + 1] + 0.5 * noise[i])
    return x


@pytest.fixture
def with_nulls(series):
    """Readings whose value is null where none is given."""

    def make(data):
        filled = {k: [-999.0 if v is None else v for v in x] for k, x in data.items()}
        return series(filled).withColumn("value", F.when(F.col("value") != -999.0, F.col("value")))

    return make


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(lags, "WIDTH", 40)


@pytest.mark.parametrize("order", ORDERS)
def test_forecast_and_backtest(series, narrow, order):
    data = {f"s{n}": made(n, n) for n in (33, 90, 301)} | {"tiny": [1.0, 2.0, 4.0]}
    table = series(data)
    rows = op.forecast_arima(table, order, ["key"], value="value", align="future", steps=50).collect()
    scores = {r.key: r for r in op.backtest(table, order, ["key"], value="value").collect()}
    for key, x in data.items():
        got = sorted((r for r in rows if r.key == key), key=lambda r: r.step)
        assert [r.step for r in got] == list(range(50))
        try:
            model = whole.fit(np.array(x), order, 1)
            rmse, tail = whole.back_test(np.array(x), order)
        except whole.TooShort:
            assert {(r.status, r.yhat, r.rmse) for r in got} == {("too_short", None, None)}
            assert (scores[key].status, scores[key].rmse, scores[key].n) == ("too_short", None, len(x))
            continue
        assert {r.status for r in got} == {"ok"}
        assert [r.yhat for r in got] == pytest.approx(list(model.forecast(50)), rel=1e-7)
        assert (scores[key].n_test, scores[key].rmse) == (tail, pytest.approx(rmse, rel=1e-7))
        wide = 1.959963984540054 * rmse * whole.spread(order, model.coef, 50)
        assert [r.hi - r.yhat for r in got] == pytest.approx(list(wide), rel=1e-7)


def test_forecast_in_place_crosses_blocks(series, narrow):
    x, order = made(200, 5), Order(1, 0, 1, 0, 1, 1, 6)
    rows = op.forecast_arima(series(x), order, ["key"], value="value", psi_shift=1).orderBy("step").collect()
    model = whole.fit(np.array(x), order, 1)
    rmse, _ = whole.back_test(np.array(x), order)
    wide = 1.959963984540054 * rmse * whole.spread(order, model.coef, 200, 1)
    assert [r.yhat for r in rows] == pytest.approx(list(model.forecast(200)))
    assert [r.yhat - r.lo for r in rows] == pytest.approx(list(wide))
    assert [r.ts for r in rows] == sorted(r.ts for r in series(x).collect())


def test_readings_without_value_take_no_position(with_nulls, narrow):
    x = made(160, 9)
    holes = [v if i % 17 else None for i, v in enumerate(x)]
    kept = np.array([v for v in holes if v is not None])
    order = Order(1, 0, 1, 0, 0, 0, 0)
    rows = op.forecast_arima(with_nulls({"m": holes, "none": [None] * 5}), order, ["key"], value="value").collect()
    model = whole.fit(kept, order, 1)
    assert [r.yhat for r in sorted(rows, key=lambda r: r.step)] == pytest.approx(list(model.forecast(len(kept))))
    assert {r.key for r in rows} == {"m"}


def test_order_search_equals_trying_each(series, narrow):
    data = {"a": made(260, 1), "b": made(140, 2)}
    grid = op.order_grid(1, 0, 1, 0, 1, 1, 6)
    got = op.auto_arima(series(data), grid, 12, period="30 minutes").orderBy("key", "step").collect()
    since = max(max([0, *o.ar, *o.ma]) for o in grid)
    for key, x in data.items():
        scored = []
        for number, order in enumerate(grid):
            model = whole.fit(np.array(x), order, 1)
            e = model.errors()[since:]
            n, k = len(e), len(model.coef) + 2
            scored.append((n * np.log(np.mean(e**2)) + 2 * k + 2 * k * (k + 1) / (n - k - 1), number, model, e))
        score, _, model, e = min(scored, key=lambda s: s[:2])
        rows = [r for r in got if r.key == key]
        assert (rows[0].p, rows[0].q, rows[0].seasonal_q, rows[0].m) == (model.order.p, model.order.q, model.order.Q, 6)
        assert rows[0].score == pytest.approx(score)
        assert [r.yhat for r in rows] == pytest.approx(list(model.forecast(12)))
        wide = 1.959963984540054 * np.sqrt(np.mean(e**2)) * whole.spread(model.order, model.coef, 12)
        assert [r.hi95 - r.yhat for r in rows] == pytest.approx(list(wide))


def test_residuals_by_doubling(with_nulls, narrow):
    x = [random.Random(3).gauss(0, 1) * (i % 7) for i in range(700)]
    ar, ma = {1: 0.3, 5: 0.1}, {1: 0.4, 3: -0.2}
    holes = [None if i % 50 == 3 else v for i, v in enumerate(x)]
    kept = np.array([v for v in holes if v is not None])
    expected = whole.errors(kept, [1, 5], [1, 3], np.array([0.3, 0.1, 0.4, -0.2]))
    rows = op.arma_residuals(with_nulls({"k": holes, "one": [2.5]}), ar, ma).collect()
    mine = sorted((r for r in rows if r.key == "k" and r.value is not None), key=lambda r: r.i)
    assert [r.residual for r in mine] == pytest.approx(list(expected))
    assert [r.ts for r in mine] == sorted(r.ts for r in mine)
    assert {(r.i, r.residual) for r in rows if r.value is None} == {(None, None)}
    assert [(r.i, r.residual) for r in rows if r.key == "one"] == [(0, 0.0)]


def test_an_empty_table(series):
    nothing = series([1.0]).where("false")
    order = Order(1, 0, 1, 0, 0, 0, 0)
    assert op.forecast_arima(nothing, order, ["key"], value="value").count() == 0
    assert op.arma_residuals(nothing, {1: 0.5}, {1: 0.1}).count() == 0
