"""Lag models of a whole series in memory: what the block sums of the library must equal."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from meterloom.functions.arma import HOLD_OUT, ROUNDS, Order, solve_limited, yule_walker


class TooShort(ValueError):
    """The series has too few points for the order."""


def autocovariances(x: np.ndarray, top: int) -> np.ndarray:
    n = len(x)
    return np.array([x[: n - j] @ x[j:] / n if j < n else 0.0 for j in range(top + 1)])


def _lag_rows(x: np.ndarray, lags: list[int], start: int, stop: int) -> np.ndarray:
    return np.array([x[start - k : stop - k] for k in lags]).reshape(len(lags), stop - start)


def errors(x: np.ndarray, ar: list[int], ma: list[int], coef: np.ndarray) -> np.ndarray:
    """One-step errors; zero before the longest lag."""
    start = max([0, *ar, *ma])
    out = np.zeros(len(x))
    if start >= len(x):
        return out
    phi, theta = coef[: len(ar)], coef[len(ar) :]
    out[start:] = x[start:] - phi @ _lag_rows(x, ar, start, len(x))
    if ma:
        back = np.array(ma)
        for t in range(start, len(x)):
            out[t] -= theta @ out[t - back]
    return out


def extend(x: np.ndarray, ar: list[int], ma: list[int], coef: np.ndarray, steps: int) -> np.ndarray:
    """Forecasts after ``x`` with future errors zero."""
    n = len(x)
    path = np.concatenate([x, np.zeros(steps)])
    shock = np.concatenate([errors(x, ar, ma, coef), np.zeros(steps)])
    a, b = np.array(ar, dtype=int), np.array(ma, dtype=int)
    phi, theta = coef[: len(ar)], coef[len(ar) :]
    for t in range(n, n + steps):
        path[t] = phi @ path[t - a] + theta @ shock[t - b]
    return path[n:]


def fit_arma(x: np.ndarray, ar: list[int], ma: list[int], tail: int) -> np.ndarray:
    """Coefficients by repeated least squares on lagged data and lagged errors.

    A long autoregression gives the first errors.  Each round's coefficients are
    scored on the last ``tail`` points; the best round counts, the first of equals.
    """
    r = 1 + max([0, *ar, *ma])
    stop = len(x) - tail
    if stop < 2 * r:
        raise TooShort(f"{len(x)} points, {2 * r + tail} needed")
    if not ar and not ma:
        return np.zeros(0)
    noise = np.zeros(stop)
    phi = yule_walker(autocovariances(x, r))
    noise[r:] = x[r:stop] - phi @ _lag_rows(x, list(range(1, r + 1)), r, stop)
    best, lowest = None, None
    for _ in range(ROUNDS):
        design = np.vstack([_lag_rows(x, ar, r, stop), _lag_rows(noise, ma, r, stop)])
        coef = solve_limited(design @ design.T, design @ x[r:stop])
        miss = x[stop:] - extend(x[:stop], ar, ma, coef, tail)
        score = float(np.sqrt(np.mean(miss**2)))
        if lowest is None or score < lowest:
            best, lowest = coef, score
        noise[r:] = x[r:stop] - extend(x[:r], ar, ma, coef, stop - r)
    return best


class Fitted(NamedTuple):
    """A model fitted to a series, ready to forecast from its end."""

    order: Order
    levels: list[tuple[int, np.ndarray]]
    stationary: np.ndarray
    mean: float
    coef: np.ndarray

    def forecast(self, steps: int) -> np.ndarray:
        out = self.mean + extend(self.stationary, self.order.ar, self.order.ma, self.coef, steps)
        for lag, level in reversed(self.levels):
            path = np.concatenate([level[-lag:], out])
            for t in range(lag, len(path)):
                path[t] += path[t - lag]
            out = path[lag:]
        return out

    def errors(self) -> np.ndarray:
        return errors(self.stationary, self.order.ar, self.order.ma, self.coef)


def fit(x: np.ndarray, order: Order, tail: int) -> Fitted:
    """Difference, centre and fit; ``tail`` points choose the round."""
    if len(x) <= order.lost or tail < 1:
        raise TooShort(f"{len(x)} points")
    levels, z = [], np.asarray(x, dtype=float)
    for lag in [order.m] * order.seasonal_differences + [1] * order.d:
        levels.append((lag, z))
        z = z[lag:] - z[:-lag]
    mean = float(z.mean())
    z = z - mean
    return Fitted(order, levels, z, mean, fit_arma(z, order.ar, order.ma, tail))


def back_test(x: np.ndarray, order: Order, share: float = HOLD_OUT) -> tuple[float, int]:
    """Error on the last ``share`` of the points of a model fitted to the others."""
    tail = int(len(x) * share)
    train = len(x) - tail
    miss = x[train:] - fit(x[:train], order, tail).forecast(tail)
    return float(np.sqrt(np.mean(miss**2))), tail


def spread(order: Order, coef: np.ndarray, steps: int, shift: int = 0) -> np.ndarray:
    """Square root of the running sum of squared moving-average weights per step.

    ``shift=1`` moves every coefficient one lag later.
    """
    phi, theta = np.zeros(steps + 1), np.zeros(steps + 1)
    for target, lags, values in (
        (phi, order.ar, coef[: len(order.ar)]),
        (theta, order.ma, coef[len(order.ar) :]),
    ):
        for lag, value in zip(lags, values):
            if lag + shift <= steps:
                target[lag + shift] = value
    weights = np.zeros(steps)
    weights[0] = 1.0
    used = np.flatnonzero(phi)
    for k in range(1, steps):
        past = used[used <= k]
        weights[k] = theta[k] + phi[past] @ weights[k - past]
    return np.sqrt(np.cumsum(weights**2))
