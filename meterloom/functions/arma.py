"""Orders as lag sets, and the small solves of one series' sums.

A model is two sets of lags with one coefficient each; a seasonal order only
decides which lags there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Fixed values shared with the aggregate path.
ROUNDS = 5
HOLD_OUT = 0.15
MAX_CONDITION = 100.0


class Order(NamedTuple):
    """Seasonal order (p, d, q)(P, D, Q) with period m; m = 0 means not seasonal."""

    p: int = 0
    d: int = 0
    q: int = 1
    P: int = 1
    D: int = 1
    Q: int = 0
    m: int = 0

    @property
    def ar(self) -> list[int]:
        return _lags(self.p, self.P, self.m)

    @property
    def ma(self) -> list[int]:
        return _lags(self.q, self.Q, self.m)

    @property
    def seasonal_differences(self) -> int:
        return self.D if self.m > 0 else 0

    @property
    def lost(self) -> int:
        """Points used up by differencing."""
        return self.d + self.seasonal_differences * self.m


def _lags(short: int, seasons: int, period: int) -> list[int]:
    return sorted({j + s * period for j in range(short + 1) for s in range(seasons + 1)} - {0})


def solve_limited(a: np.ndarray, b: np.ndarray, limit: float = MAX_CONDITION) -> np.ndarray:
    """Symmetric solve by elimination whose pivots never fall under largest / limit."""
    rest, rhs = np.array(a, dtype=float), np.array(b, dtype=float)
    size, largest = len(rhs), 0.0
    pivots = np.empty(size)
    unit = np.eye(size)
    for j in range(size):
        pivot = rest[j, j]
        if pivot == 0:
            pivot = largest / limit if largest else 1.0
        elif largest and abs(pivot) * limit < largest:
            pivot = np.copysign(largest / limit, pivot)
        pivots[j], largest = pivot, max(largest, abs(pivot))
        unit[j + 1 :, j] = rest[j + 1 :, j] / pivot
        rest[j + 1 :, j + 1 :] -= pivot * np.outer(unit[j + 1 :, j], unit[j + 1 :, j])
    if not size:
        return rhs
    forward = np.linalg.solve(unit, rhs)
    return np.linalg.solve(unit.T, forward / pivots)


def yule_walker(acov: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of order ``len(acov) - 1``."""
    p = len(acov) - 1
    index = np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
    return solve_limited(acov[index], acov[1:])
