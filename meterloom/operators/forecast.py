"""Per-series ARIMA: forecast, back-test, order search, autoregression, residuals.

Series are the groups of ``keys``, of any length.  The default order runs as plain
aggregates (`forecast_ma1`), others as sums over blocks of readings (`forecast_lags`).
Readings without a value count as missing: they are left out and take no position.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions import arma
from meterloom.functions.arma import Order
from meterloom.functions.blocks import TIME_BLOCK, duration_us
from meterloom.functions.recursion import dense
from meterloom.operators import forecast_lags as lags
from meterloom.operators import forecast_ma1
from meterloom.operators.series import autocovariance
from meterloom.session import stage

SERIES = ("key", "profile_key", "dow")
DEFAULT_ORDER = Order()
# Column names of an order; Spark does not tell p from P.
ORDER_COLUMNS = ("p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "m")
# Normal quantiles of 95 % and 80 % intervals.
Z95 = forecast_ma1.Z95
Z80 = 1.2815515655446004


def _is_plain_ma1(order: Order) -> bool:
    return not order.ar and order.ma == [1] and order.lost == 0


def _log(order: Order, steps: Column, n: Column) -> Column:
    """Fit record as JSON text."""
    summary = ", ".join(f"{name}= {value}" for name, value in order._asdict().items())
    return F.to_json(
        F.struct(
            F.lit(summary).alias("params"),
            steps.cast("long").alias("forecast_size"),
            n.cast("long").alias("input_size"),
        )
    )


def _future(last: Column, step: Column, period: str | timedelta) -> Column:
    return F.timestamp_micros(F.unix_micros(last.cast("timestamp")) + (step + 1) * duration_us(period))


def _ma1_spread(step: Column, shift: int) -> Column:
    return F.when(step >= 1 + shift, F.sqrt(1 + F.col("theta") * F.col("theta"))).otherwise(1.0)


def forecast_arima(
    series: DataFrame,
    order: Order = DEFAULT_ORDER,
    keys: Sequence[str] = SERIES,
    ts: str = "ts",
    value: str = "adjusted",
    align: str = "in_place",
    steps: int | None = None,
    period: str | timedelta = "30 minutes",
    psi_shift: int = 0,
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Forecast every series: ``(keys, step, ts, yhat, lo, hi, rmse, status, log)``.

    ``in_place``: as many steps as readings, step i stamped with the i-th reading's
    time.  ``future``: ``steps`` steps, one ``period`` apart after the last reading.
    ``rmse`` comes from a back-test on the last 15 % and sets the 95 % bounds.
    Series too short for it have null forecasts and status ``too_short``.
    """
    if align not in ("in_place", "future"):
        raise ValueError("align is 'in_place' or 'future'")
    if align == "future" and not steps:
        raise ValueError("a future forecast needs steps")
    if _is_plain_ma1(order):
        return _forecast_ma1(
            series, order, keys, ts, value, align, steps, period, psi_shift, block
        )
    return _forecast_general(
        series, order, keys, ts, value, align, steps, period, psi_shift, block
    )


def _forecast_ma1(
    series, order, keys, ts, value, align, steps, period, psi_shift, block
) -> DataFrame:
    blocks = forecast_ma1.cut(series, keys, ts, value, block)
    params = forecast_ma1.estimate(blocks)
    if align == "in_place":
        rows = blocks.rows(extra=params.drop("n")).withColumnRenamed("i", "step")
        rows = rows.withColumn("_size", F.col("n"))
    else:
        ends = blocks.packed.groupBy(*keys).agg(F.max(F.element_at("_rows", -1)[ts]).alias("_last"))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))
        rows = (
            ends.join(params, list(keys))
            .withColumn("step", F.explode(numbers))
            .withColumn(ts, _future(F.col("_last"), F.col("step"), period))
            .withColumn("_size", F.lit(steps))
        )
    step = F.col("step")
    yhat = F.col("mu") + F.when(step == 0, F.col("theta") * F.col("error")).otherwise(0.0)
    bound = Z95 * F.col("rmse") * _ma1_spread(step, psi_shift)
    return rows.select(
        *keys,
        step,
        ts,
        yhat.alias("yhat"),
        (yhat - bound).alias("lo"),
        (yhat + bound).alias("hi"),
        "rmse",
        "status",
        _log(order, F.col("_size"), F.col("n")).alias("log"),
    )


def _forecast_general(
    series, order, keys, ts, value, align, steps, period, psi_shift, block
) -> DataFrame:
    keys = list(keys)
    parts = stage(lags.cut(series, keys, ts, value, lags.back_needed([order]), block), "series-blocks")
    models = lags.fitted(parts, keys, [order])
    full = models.where("NOT _held").drop("rmse", "_n", lags.WHICH)
    held = models.where("_held").select(*keys, "rmse")
    both = full.join(held, keys)
    if align == "in_place":
        ahead = parts.select(*keys, "_n", F.col("_start").alias("_from"), F.size("_x").alias("_count"), "_us")
    else:
        gap, zero = duration_us(period), F.lit(0).cast("long")
        last = parts.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max(F.element_at("_us", -1)).alias("_last"))
        times = F.transform(F.sequence(zero + 1, F.lit(steps).cast("long")), lambda k: F.col("_last") + k * gap)
        ahead = last.select(*keys, "_n", zero.alias("_from"), F.lit(steps).alias("_count"), times.alias("_us"))
    rows = ahead.join(both, keys, "left").withColumn("_path", lags.predicted(psi_shift))
    each = F.arrays_zip(F.col("_us"), F.col("_path.yhat").alias("yhat"), F.col("_path.spread").alias("spread"))
    rows = rows.select(*keys, "_n", "_from", "coef", "rmse", F.posexplode(each).alias("_k", "_f"))
    known = F.col("coef").isNotNull()
    bound = Z95 * F.col("rmse") * F.col("_f.spread")
    yhat = F.col("_f.yhat")
    numbers = {"yhat": yhat, "lo": yhat - bound, "hi": yhat + bound, "rmse": F.col("rmse")}
    size = F.col("_n") if align == "in_place" else F.lit(steps)
    return rows.select(
        *keys,
        (F.col("_from") + F.col("_k")).alias("step"),
        F.timestamp_micros("_f._us").alias(ts),
        *[F.when(known, number).alias(name) for name, number in numbers.items()],
        F.when(known, "ok").otherwise("too_short").alias("status"),
        _log(order, size, F.col("_n")).alias("log"),
    )


def forecast_models(
    series: DataFrame,
    keys: Sequence[str] = SERIES,
    ts: str = "ts",
    value: str = "adjusted",
    psi_shift: int = 0,
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """One row per series with the fitted default model; null where ``status`` is not ``ok``.

    ``n, mu, theta, error, n_test, rmse, variance`` and ``max_normalized_variance``,
    the largest squared 95 % bound over the forecast relative to the data variance.
    """
    blocks = forecast_ma1.cut(series, keys, ts, value, block)
    models = forecast_ma1.estimate(blocks)
    bound = Z95 * F.col("rmse") * _ma1_spread(F.col("n") - 1, psi_shift)
    square = bound * bound
    # Fixed value: variances under this count as zero.
    relative = F.when(F.col("variance") < 1e-7, square).otherwise(F.abs(square / F.col("variance")))
    return models.withColumn("max_normalized_variance", relative)


def backtest(
    series: DataFrame,
    order: Order = DEFAULT_ORDER,
    keys: Sequence[str] = SERIES,
    ts: str = "ts",
    value: str = "adjusted",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """``(keys, n, n_test, rmse, status)``: error on the last 15 % of every series."""
    keys = list(keys)
    if _is_plain_ma1(order):
        blocks = forecast_ma1.cut(series, keys, ts, value, block)
        return forecast_ma1.estimate(blocks).select(*keys, "n", "n_test", "rmse", "status")

    parts = stage(lags.cut(series, keys, ts, value, lags.back_needed([order]), block), "series-blocks")
    models = lags.fitted(parts, keys, [order], held=[True]).select(*keys, "rmse", F.lit("ok").alias("_ok"))
    lengths = parts.groupBy(*keys).agg(F.max("_n").alias("n"))
    tail = F.floor(F.col("n") * F.lit(arma.HOLD_OUT)).cast("long")
    return lengths.join(models, keys, "left").select(
        *keys,
        "n",
        F.when(F.col("_ok").isNotNull(), tail).alias("n_test"),
        "rmse",
        F.coalesce("_ok", F.lit("too_short")).alias("status"),
    )


def fit_orders(
    series: DataFrame,
    orders: Sequence[Order],
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """``(keys, model, held, n, mean, coefficients, rmse)``: every order fitted to every series.

    ``model`` is the order's number; ``held`` fits leave out the last 15 %, on which ``rmse``
    scores them.  ``coefficients`` are ``(lag, coefficient)``, autoregressive lags first.
    Series too short for an order have no row.
    """
    parts = stage(lags.cut(series, keys, ts, value, lags.back_needed(orders), block), "series-blocks")
    sets = F.array(*[F.array(*[F.lit(k) for k in (*o.ar, *o.ma)]).cast("array<int>") for o in orders])
    return lags.fitted(parts, keys, orders).select(
        *keys,
        F.col(lags.WHICH).alias("model"),
        F.col("_held").alias("held"),
        F.col("_n").alias("n"),
        "mean",
        F.arrays_zip(
            F.get(sets, F.col(lags.WHICH)).alias("lag"), F.col("coef").alias("coefficient")
        ).alias("coefficients"),
        "rmse",
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _yule_walker(acov: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in acov:
        yield batch.map(lambda r: arma.yule_walker(np.asarray(r, dtype=float)))


def fit_ar(
    series: DataFrame,
    p: int,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """``(keys, n, phi)``: autoregression of order ``p`` from the autocovariances."""
    if p < 1:
        raise ValueError("p must be positive")
    return autocovariance(series, p, keys, ts, value, block).select(
        *keys, "n", _yule_walker("acov").alias("phi")
    )


def order_grid(
    p: int = 3, d: int = 0, q: int = 1, P: int = 0, D: int = 1, Q: int = 2, m: int = 24
) -> list[Order]:
    """Every order with AR and MA degrees up to the given ones; 24 by default."""
    return [
        Order(a, d, b, A, D, B, m)
        for a in range(p + 1)
        for b in range(q + 1)
        for A in range(P + 1)
        for B in range(Q + 1)
    ]


def auto_arima(
    series: DataFrame,
    grid: Sequence[Order] | None = None,
    steps: int = 48,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    period: str | timedelta = "1 hour",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Best order of ``grid`` per series by information criterion, and its forecast.

    ``(keys, order columns, score, step, ts, yhat, lo80, hi80, lo95, hi95, status)``.  All
    candidates are estimated in the same passes over one table of blocks; the criterion
    counts one-step errors from the longest lag of any candidate on.
    """
    candidates, keys = list(grid or order_grid()), list(keys)
    since = max(max([0, *o.ar, *o.ma]) for o in candidates)
    parts = stage(lags.cut(series, keys, ts, value, lags.back_needed(candidates), block), "series-blocks")
    models = lags.fitted(parts, keys, candidates, held=[False])
    errors = lags.error_squares(parts, models, keys, since)
    n, k = F.col("n_errors"), F.size("coef") + 2
    mean = F.col("squares") / n
    score = n * F.log(F.greatest(mean, F.lit(1e-300))) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    scored = models.join(errors, [*keys, lags.WHICH]).where(n - k - 1 >= 1)
    scored = scored.withColumns({"score": score, "_sigma": F.sqrt(mean)})
    whole = F.struct(*[c for c in scored.columns if c not in (*keys, "_n")])
    best = scored.groupBy(*keys).agg(F.min_by(whole, F.struct("score", lags.WHICH)).alias("_b"))
    gap, zero = duration_us(period), F.lit(0).cast("long")
    last = parts.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max(F.element_at("_us", -1)).alias("_last"))
    rows = last.join(best.select(*keys, "_b.*"), keys, "left")
    rows = rows.withColumns({"_from": zero, "_count": F.lit(steps)}).withColumn("_path", lags.predicted())
    each = F.arrays_zip(F.col("_path.yhat").alias("yhat"), F.col("_path.spread").alias("spread"))
    rows = rows.select(*keys, "_last", "coef", "score", "_sigma", *lags.ORDER, F.posexplode(each).alias("step", "_f"))
    known, yhat = F.col("coef").isNotNull(), F.col("_f.yhat")
    bounds = {"yhat": yhat}
    for name, z in (("80", Z80), ("95", Z95)):
        off = z * F.col("_sigma") * F.col("_f.spread")
        bounds |= {f"lo{name}": yhat - off, f"hi{name}": yhat + off}
    return rows.select(
        *keys,
        *[F.col(own).alias(name) for own, name in zip(lags.ORDER, ORDER_COLUMNS)],
        "score",
        F.col("step").cast("long").alias("step"),
        F.timestamp_micros(F.col("_last") + (F.col("step").cast("long") + 1) * gap).alias(ts),
        *[F.when(known, number).alias(name) for name, number in bounds.items()],
        F.when(known, "ok").otherwise("too_short").alias("status"),
    )


def arma_residuals(
    series: DataFrame,
    ar: Mapping[int, float] | None = None,
    ma: Mapping[int, float] | None = None,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Add ``i`` and ``residual``, the one-step errors of a given lag model.

    Errors before the longest lag are zero.  Each block runs the recursion from rest;
    what the blocks before it add is linear in their last errors, which are put together
    over one small row per block.  Rows without a value take no position: their ``i`` and
    ``residual`` are null.
    """
    keys, columns = list(keys), series.columns
    phi, theta = (dense(list(m or {}), list((m or {}).values())) for m in (ar, ma))
    others = [c for c in columns if c not in keys]
    parts = lags.cut(series, keys, ts, value, len(phi), block, others)
    rows = lags.residual_rows(parts, keys, phi, theta)
    each = rows.select(
        *keys, "_start", F.posexplode(F.arrays_zip("_also", "_e")).alias("_k", "_z")
    )
    found = each.select(
        *[F.col(c) if c in keys else F.col(f"_z._also.{c}").alias(c) for c in columns],
        (F.col("_start") + F.col("_k")).alias("i"),
        F.col("_z._e").alias("residual"),
    )
    blank = series.where(F.col(value).isNull()).select(
        "*", F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("residual")
    )
    return found.unionByName(blank)
