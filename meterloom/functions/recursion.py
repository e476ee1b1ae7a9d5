"""Linear recursions by blocks: values far ahead without the values between.

``y_t = const + c_1 y_{t-1} + ... + c_R y_{t-R}`` maps the last R values to any later
stretch by powers of one small matrix.  So a block of a long series can be worked on
without its predecessors: what they contribute is a state of R numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def dense(lags: Sequence[int], values: Sequence[float]) -> np.ndarray:
    """Coefficients by lag, position k for lag k + 1."""
    out = np.zeros(max(lags, default=0))
    for lag, value in zip(lags, values):
        out[lag - 1] = value
    return out


class Recursion:
    """Values of a recursion from the R values before them, oldest first."""

    def __init__(self, coefficients: np.ndarray, const: float = 0.0) -> None:
        self.size = len(coefficients)
        row = np.append(coefficients[::-1], const)
        self._squares = [np.vstack([np.eye(self.size + 1, k=1)[: self.size - 1], row, np.eye(self.size + 1)[-1]])]
        if not self.size:
            self._squares = [np.eye(1)]
        self._basis = row[None]

    def power(self, steps: int) -> np.ndarray:
        """Matrix from a state (with a last entry of one) to that ``steps`` later."""
        out, k = np.eye(self.size + 1), 0
        while steps:
            if k == len(self._squares):
                self._squares.append(self._squares[-1] @ self._squares[-1])
            if steps & 1:
                out = self._squares[k] @ out
            steps, k = steps >> 1, k + 1
        return out

    def basis(self, count: int) -> np.ndarray:
        """Rows that give the next ``count`` values from a state."""
        while len(self._basis) < count:
            self._basis = np.vstack([self._basis, self._basis @ self.power(len(self._basis))])
        return self._basis[:count]

    def values(self, state: np.ndarray, start: int, count: int) -> np.ndarray:
        """``count`` values from the ``start``-th after ``state`` on."""
        return self.basis(count) @ (self.power(start) @ np.append(state, 1.0))

    def impulse(self, count: int) -> np.ndarray:
        """Response to a single one, itself first (without the constant)."""
        if not self.size or count < 2:
            return np.eye(1, max(count, 1))[0][:count]
        return np.append(1.0, self.basis(count - 1)[:, self.size - 1])

    def squares(self, state: np.ndarray, count: int) -> float:
        """Sum of squares of the next ``count`` values (without the constant)."""
        total, done = np.zeros((self.size + 1,) * 2), 0
        unit = np.outer(self._basis[0], self._basis[0])
        # Sums over 2^k values are put together from those over 2^(k-1).
        k, rest = 0, count
        while rest:
            if rest & 1:
                move = self.power(done)
                total += move.T @ unit @ move
                done += 1 << k
            move = self.power(1 << k)
            unit = unit + move.T @ unit @ move
            rest, k = rest >> 1, k + 1
        full = np.append(state, 1.0)
        return float(full @ total @ full)


class Path:
    """A recursion that also starts from past shocks: ``+ theta_1 e_{t-1} + ...``; later shocks are zero."""

    def __init__(
        self, coefficients: np.ndarray, theta: np.ndarray, before: np.ndarray, shocks: np.ndarray, const: float = 0.0
    ) -> None:
        size, reach = len(coefficients), len(theta)
        self.after = Recursion(coefficients, const)
        known = np.append(np.zeros(max(size - len(before), 0)), before)
        first = np.zeros(reach)
        e = np.append(np.zeros(max(reach - len(shocks), 0)), shocks)[-reach:] if reach else np.zeros(0)
        series = np.append(known, first)
        for j in range(reach):
            t = len(known) + j
            own = coefficients @ series[t - size : t][::-1] if size else 0.0
            series[t] = const + own + theta[j:] @ e[j:][::-1]
        self.first = series[len(known) :]
        self.state = series[len(series) - size :]

    def values(self, start: int, count: int) -> np.ndarray:
        reach = len(self.first)
        near = self.first[start : start + count]
        rest = count - len(near)
        if not rest:
            return near
        return np.append(near, self.after.values(self.state, max(start, reach) - reach, rest))

    def squares(self, count: int) -> float:
        """Sum of squares of the first ``count`` values."""
        near = self.first[:count]
        rest = count - len(near)
        return float(near @ near) + (self.after.squares(self.state, rest) if rest else 0.0)
