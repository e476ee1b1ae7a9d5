"""Forecasts of the default order, MA(1) around the mean, from sums alone.

For this order every quantity of the estimation is a sum over the series: means,
products at lags 0..3, and geometric sums ``sum (-theta)^k x_{t-k}`` that stand
for the recursion ``e_t = x_t - theta * e_{t-1}``.  So no series is collected: it
is shuffled once into blocks, reduced twice with map-side combining (moments, then
errors of the candidate coefficients), and one row per series goes back to it.

Notation: N points are fitted, the last f of them choose among the five
rounds, L = N - f.  ``full`` fits all n points with f = 1; ``held`` fits the
first n - t points with f = t, where t is 15 % of n, and is scored on the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.arma import HOLD_OUT, MAX_CONDITION, ROUNDS
from meterloom.functions.blocks import TIME_BLOCK, Blocks, pack, time_block

# 95 % quantile, and the shortest series that can be held out at all.
Z95 = 1.959963984540054
MIN_POINTS = 7

_FITS = ("full", "held")
_PRODUCTS = [(a, b) for a in range(4) for b in range(max(a, 1), 4)]
_CANDIDATES = T.StructType(
    [
        T.StructField("shift", T.DoubleType()),
        T.StructField("theta", T.ArrayType(T.DoubleType())),
    ]
)


def cut(
    series: DataFrame, keys: Sequence[str], ts: str, value: str, block: str | timedelta = TIME_BLOCK
) -> Blocks:
    """The series as blocks of ``x``.

    Readings without a value count as missing: they are left out and take no position.
    """
    narrow = series.select(*keys, ts, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    return pack(narrow, keys, [ts], time_block(ts, block), totals={"_sum": "x"})


def _sized(rows: DataFrame, *more: str) -> DataFrame:
    """Rows with ``mu``, the centred value ``y0`` and the N and L of both fits."""
    held = f"CAST(floor(n * {HOLD_OUT}D) AS BIGINT)"
    keep = [c for c in rows.columns if c not in ("x", "_sum")]
    return rows.selectExpr(
        *keep,
        "_sum / n AS mu",
        "x - _sum / n AS y0",
        *more,
        "n AS N_full",
        "n - 1 AS L_full",
        f"n - {held} AS N_held",
        f"n - 2 * {held} AS L_held",
    )


def _sum_if(condition: str, value: str) -> str:
    return f"coalesce(sum({value}) FILTER (WHERE {condition}), 0D)"


def _at(position: str, value: str = "y0") -> str:
    return f"max({value}) FILTER (WHERE i = {position})"


def _struct(cells: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in cells.items()) + ")"


def _moments(blocks: Blocks) -> DataFrame:
    """Every sum over the lagged rows that the two estimations need, per series.

    ``y`` is centred on the whole series, so only the ``held`` fit, whose mean is that of
    fewer points, needs sums of y next to the sums of products.
    """
    lagged = blocks.shifted({f"y{k}": ("x", k) for k in (1, 2, 3)})
    for_lags = {f"y{k}": F.expr(f"y{k} - _sum / n") for k in (1, 2, 3)}
    rows = _sized(lagged.withColumns(for_lags))
    start = ", ".join(_at(str(k)) for k in range(4))
    sums = ["any_value(mu) AS mu", f"array({start}) AS start"]
    for fit in _FITS:
        fitted, train = f"i < N_{fit}", f"i >= 3 AND i < L_{fit}"
        cells = {"N": f"any_value(N_{fit})", "L": f"any_value(L_{fit})", "last": _at(f"L_{fit}")}
        for j in range(3):
            cells[f"r{j}"] = _sum_if(f"{fitted} AND i >= {j}", f"y0 * y{j}")
        for a, b in _PRODUCTS:
            cells[f"p{a}{b}"] = _sum_if(train, f"y{a} * y{b}")
        if fit == "held":
            cells["sum"] = _sum_if(fitted, "y0")
            for j in range(3):
                cells[f"e{j}"] = _sum_if(f"{fitted} AND i >= {j}", f"y0 + y{j}")
            for a in range(4):
                cells[f"s{a}"] = _sum_if(train, f"y{a}")
        sums.append(f"{_struct(cells)} AS {fit}")
    rest = {
        "sum": _sum_if("i >= N_held", "y0"),
        "square": _sum_if("i >= N_held", "y0 * y0"),
        "first": _at("N_held"),
    }
    sums.append(f"{_struct(rest)} AS rest")
    return rows.groupBy(*blocks.keys).agg(*[F.expr(sql) for sql in sums])


def _limited(pivot: np.ndarray, largest: np.ndarray | float) -> np.ndarray:
    """Pivots, none smaller than largest / 100; one where there is no scale yet."""
    least = np.where(largest > 0, largest / MAX_CONDITION, 1.0)
    small = np.abs(pivot) * MAX_CONDITION < largest
    return np.where(pivot == 0, least, np.where(small, np.copysign(least, pivot), pivot))


def _candidate_coefficients(m: pd.DataFrame, start: pd.Series) -> pd.DataFrame:
    """Mean shift and the coefficient of every round, for many series at once.

    Series that are too short give meaningless numbers here and are masked later.
    """
    none = np.zeros(len(m))
    total = lambda name: m[name].to_numpy() if name in m else none
    shift = total("sum") / m["N"].to_numpy()
    # The fit's own mean differs from the series mean by `shift`; products of
    # y - shift follow from products and sums of y.
    c = [(m[f"r{j}"] - shift * total(f"e{j}") + (m["N"] - j) * shift**2) / m["N"] for j in range(3)]
    count = m["L"] - 3
    p = {
        (a, b): m[f"p{a}{b}"] - shift * (total(f"s{a}") + total(f"s{b}")) + count * shift**2
        for a, b in _PRODUCTS
    }
    _, y1, y2, y3 = np.array(start.tolist(), dtype=float).T - shift
    # An autoregression of order 2 gives the first errors.
    d0 = _limited(c[0], 0.0)
    slope = c[1] / d0
    phi2 = (c[2] - slope * c[1]) / _limited(c[0] - slope * c[1], np.abs(d0))
    phi1 = c[1] / d0 - slope * phi2
    top = p[0, 1] - phi1 * p[0, 2] - phi2 * p[0, 3]
    bottom = p[1, 1] + phi1**2 * p[2, 2] + phi2**2 * p[3, 3]
    bottom += 2 * (phi1 * phi2 * p[2, 3] - phi1 * p[1, 2] - phi2 * p[1, 3])
    theta = [top / _limited(bottom, 0.0)]
    # In later rounds the errors restart at position 2 and equal the data from 3 on.
    for _ in range(ROUNDS - 1):
        error = y2 - theta[-1] * y1
        top = y3 * error + p[0, 1] - y3 * y2
        bottom = error**2 + p[1, 1] - y2**2
        theta.append(top / _limited(bottom, 0.0))
    return pd.DataFrame({"shift": shift, "theta": list(np.stack(theta, axis=1))})


@F.pandas_udf(_CANDIDATES)
def _candidates(moments: pd.DataFrame, start: pd.Series) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        return _candidate_coefficients(moments, start)


def _errors(blocks: Blocks, candidates: DataFrame) -> DataFrame:
    """Geometric sums up to position L-1 per candidate, and for ``held`` from L to N-1.

    The columns of ``candidates`` are constant per series and kept.
    """
    plain = {f"{fit}_shift": F.col(f"c_{fit}.shift") for fit in _FITS}
    plain |= {f"{fit}_theta{k}": F.get(f"c_{fit}.theta", k) for fit in _FITS for k in range(ROUNDS)}
    kept_fields = candidates.schema["kept"].dataType.names
    plain |= {f"kept_{name}": F.col(f"kept.{name}") for name in kept_fields}
    # Plain numbers, not structs: sums beside them need no sort of all rows by series.
    flat = candidates.select(*blocks.keys, *[c.cast("double").alias(name) for name, c in plain.items()])
    rows = _sized(blocks.rows(extra=flat))
    kept = ["n", "N_full", "L_full", "N_held", "L_held", *plain]
    sums = [f"any_value({c}) AS {c}" for c in kept]
    for fit in _FITS:
        N, L = f"N_{fit}", f"L_{fit}"
        early, late = f"i >= 1 AND i < {L}", f"i >= {L} AND i < {N}"
        for k in range(ROUNDS):
            base, value = f"-{fit}_theta{k}", f"(y0 - {fit}_shift)"
            sums.append(
                f"{_sum_if(early, f'pow({base}, {L} - 1 - i) * {value}')} AS {fit}_early{k}"
            )
            if fit == "held":
                sums.append(f"{_sum_if(late, f'pow({base}, {N} - 1 - i) * {value}')} AS {fit}_late{k}")
    totals = rows.groupBy(*blocks.keys).agg(*[F.expr(sql) for sql in sums])
    fits = [
        F.struct(
            F.col(f"{fit}_shift").alias("shift"),
            F.array(*[f"{fit}_theta{k}" for k in range(ROUNDS)]).alias("theta"),
        ).alias(f"c_{fit}")
        for fit in _FITS
    ]
    others = [c for c in totals.columns if c not in plain]
    return totals.select(
        *others, *fits, F.struct(*[F.col(f"kept_{name}").alias(name) for name in kept_fields]).alias("kept")
    )


def _best(fit: str) -> Column:
    """Candidate with the lowest held-back error, the first of equals."""
    target = f"(kept.{fit}_last - c_{fit}.shift)"
    choices = []
    for k in range(ROUNDS):
        theta, early = f"get(c_{fit}.theta, {k})", f"{fit}_early{k}"
        # The full fit has one row from L on, the target itself.
        late = target if fit == "full" else f"{fit}_late{k}"
        cells = {
            "score": f"abs({target} - {theta} * {early})",
            "k": str(k),
            "theta": theta,
            "error": f"pow(-{theta}, N_{fit} - L_{fit}) * {early} + {late}",
        }
        choices.append(_struct(cells))
    return F.expr(f"array_min(array({', '.join(choices)}))")


def estimate(blocks: Blocks) -> DataFrame:
    """One row per series: ``n, mu, theta, error, n_test, rmse, variance, status``.

    ``error`` is the last one-step error, ``rmse`` that of the held-out back-test and
    ``variance`` that of the centred series.  Series of fewer than 7 points cannot be
    held out; they have ``status`` too_short and nulls.
    """
    kept = {
        "mu": F.col("mu"),
        "full_last": F.col("full.last"),
        "held_last": F.col("held.last"),
        "square": F.col("full.r0"),
        "rest_sum": F.col("rest.sum"),
        "rest_square": F.col("rest.square"),
        "rest_first": F.col("rest.first"),
    }
    candidates = _moments(blocks).select(
        *blocks.keys,
        *[_candidates(fit, "start").alias(f"c_{fit}") for fit in _FITS],
        F.struct(*[c.alias(name) for name, c in kept.items()]).alias("kept"),
    )
    both = _errors(blocks, candidates).withColumns({f"best_{fit}": _best(fit) for fit in _FITS})
    n, shift = F.col("n"), F.col("c_held.shift")
    t = n - F.col("N_held")
    # Squared error of the mean over the held-out rows, then the first step corrected.
    spread = F.col("kept.rest_square") - 2 * shift * F.col("kept.rest_sum") + t * shift * shift
    off = F.col("kept.rest_first") - shift
    step = off - F.col("best_held.theta") * F.col("best_held.error")
    squares = F.greatest(spread - off * off, F.lit(0.0)) + step * step
    enough = n >= MIN_POINTS
    result = {
        "mu": F.col("kept.mu"),
        "theta": F.col("best_full.theta"),
        "error": F.col("best_full.error"),
        "n_test": t,
        "rmse": F.sqrt(F.try_divide(squares, t)),
        "variance": F.try_divide(F.col("kept.square"), n - 1),
    }
    return both.select(
        *blocks.keys,
        "n",
        *[F.when(enough, c).alias(name) for name, c in result.items()],
        F.when(enough, "ok").otherwise("too_short").alias("status"),
    )
