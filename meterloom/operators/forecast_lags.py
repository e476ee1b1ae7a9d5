"""Models of any lag set, estimated by sums over blocks of a series.

A series is cut into blocks of 1024 readings that also hold the few readings before
them.  Each step of the estimation is one pass: a block adds a short array of numbers
(values at given positions, lagged products, squared errors) to those of its series, and
one row per series and model goes on.  Nothing holds more of a series than a block.

Passes, for the fit to all readings and the one that holds 15 % back, of all orders at once:

1. mean of the differenced series and single values at its ends;
2. autocovariances: a long autoregression for the first errors;
3. five rounds of products of lagged values and lagged errors: the coefficients.  In
   the first round errors are those of the autoregression, later the distance to the path
   that the last coefficients predict from the first readings alone;
4. state of the one-step errors at both ends of the fitted part, per round.  Errors obey a
   linear recursion, so a block's part in a later state is a matrix power times its own;
5. squared errors of the forecasts from these states: they choose the round, and the
   chosen one's forecast of what was held back is the back-test.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions import arma
from meterloom.functions.arma import HOLD_OUT, ROUNDS, Order
from meterloom.functions.blocks import TIME_BLOCK, epoch_us, pack, time_block, with_halo
from meterloom.functions.recursion import Path, Recursion, dense
from meterloom.session import stage

WIDTH = 1024  # readings of a block
# Columns of an order, of a model's number and of its kind of fit; Spark does not tell p from P.
ORDER = ("_p", "_d", "_q", "_sp", "_sd", "_sq", "_m")
WHICH, _HELD = "_model", "_held"


def cut(
    series: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    back: int,
    block: str | timedelta = TIME_BLOCK,
    also: Sequence[str] = (),
) -> DataFrame:
    """Blocks ``keys, _blk, _n, _start, _back, _x, _us``; ``_back`` has up to ``back`` values before ``_x``.

    Readings without a value count as missing: they are left out and take no position.
    With ``also``, ``_also`` has those columns of the readings.
    """
    others = F.struct(*also).alias("_others") if also else F.lit(None).cast("boolean").alias("_others")
    narrow = series.select(*keys, epoch_us(ts).alias("_us"), F.col(value).cast("double").alias("_v"), others)
    tagged = narrow.where(F.col("_v").isNotNull())
    in_block = time_block(F.timestamp_micros("_us"), block)
    placed = pack(tagged, keys, ["_us"], in_block).rows().select(*keys, "i", "n", "_us", "_v", "_others")
    halo = with_halo(placed, "i", max(WIDTH, back), before=back)
    entry = F.struct("i", "_v", "_us", "_others")
    grouped = halo.groupBy(*keys, "_blk").agg(
        F.max("n").alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("_own"), entry))).alias("_r"),
        F.array_sort(F.collect_list(F.when(~F.col("_own"), entry))).alias("_h"),
    )
    return grouped.where(F.size("_r") > 0).select(
        *keys,
        "_blk",
        "_n",
        F.col("_r")[0]["i"].alias("_start"),
        F.col("_h._v").alias("_back"),
        F.col("_r._v").alias("_x"),
        F.col("_r._us").alias("_us"),
        *([F.col("_r._others").alias("_also")] if also else []),
    )


class Fit(NamedTuple):
    """Lengths of one fit of an order to a series of ``n`` readings."""

    order: Order
    n: int
    held: bool

    @property
    def tail(self) -> int:
        return int(self.n * HOLD_OUT) if self.held else 1

    @property
    def train(self) -> int:
        """Readings fitted."""
        return self.n - self.tail if self.held else self.n

    @property
    def size(self) -> int:
        return self.train - self.order.lost

    @property
    def stop(self) -> int:
        return self.size - self.tail

    @property
    def reach(self) -> int:
        return 1 + max([0, *self.order.ar, *self.order.ma])

    @property
    def long(self) -> int:
        """Lags of the recursion of the series itself, differencing included."""
        return max(self.order.ar, default=0) + self.order.lost

    def integrated(self, phi: np.ndarray) -> np.ndarray:
        """Coefficients by lag of the series itself."""
        poly = np.append(1.0, -phi)
        for lag in [self.order.m] * self.order.seasonal_differences + [1] * self.order.d:
            poly = np.convolve(poly, np.append(1.0, np.append(np.zeros(lag - 1), -1.0)))
        return -poly[1:]

    def split(self, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Autoregressive and moving-average coefficients by lag."""
        k = len(self.order.ar)
        return dense(self.order.ar, coef[:k]), dense(self.order.ma, coef[k:])


def back_needed(orders: Sequence[Order]) -> int:
    return max(o.lost + max(o.ma, default=0) + 1 + max([0, *o.ar, *o.ma]) for o in orders)


# ---- one block -----------------------------------------------------------------------


class _Block:
    """Differenced values of a block with the ``halo`` before them, zero before the series."""

    def __init__(self, fit: Fit, start: int, back: np.ndarray, x: np.ndarray, mean: float) -> None:
        order, first = fit.order, start - len(back)
        w = np.concatenate([back, x])
        for lag in [order.m] * order.seasonal_differences + [1] * order.d:
            w = w[lag:] - w[:-lag] if len(w) > lag else w[:0]
        self.x, self.start = x, start
        # The values are at positions first .. of the differenced series.
        self.at = max(0, start - order.lost)
        self.count = max(0, start + len(x) - order.lost - self.at)
        self.halo = max(order.ma, default=0) + fit.reach
        known = w[max(0, self.at - self.halo - first) : self.at - first + self.count] - mean
        self.z = np.append(np.zeros(max(self.halo + self.count - len(known), 0)), known)
        self.index = np.arange(self.at, self.at + self.count)

    def lagged(self, lag: int, more: int = 0) -> np.ndarray:
        """Values ``lag`` earlier, for ``more`` positions before the block too."""
        return self.z[self.halo - lag - more : self.halo - lag + self.count]

    def own(self) -> np.ndarray:
        return self.z[self.halo :]


def _at(values: np.ndarray, first: int, start: int, count: int) -> np.ndarray:
    """``count`` values from position ``start``; zero where this block does not hold them."""
    out = np.zeros(count)
    low, high = max(start, first, 0), min(start + count, first + len(values))
    if low < high:
        out[low - start : high - start] = values[low - first : high - first]
    return out


def _ends(fit: Fit, b: _Block, m: dict) -> np.ndarray:
    w, r = b.own(), fit.reach
    inside = b.index < fit.size
    pieces = [[w[inside].sum()], _at(w, b.at, 0, r), _at(w, b.at, fit.stop - r, r)]
    pieces.append(_at(b.x, b.start, fit.train - fit.long, fit.long))
    return np.concatenate(pieces)


def _products(fit: Fit, b: _Block, m: dict) -> np.ndarray:
    own = np.where(b.index < fit.size, b.own(), 0.0)
    return np.array([own @ b.lagged(h) for h in range(fit.reach + 1)])


def _round(fit: Fit, b: _Block, m: dict) -> np.ndarray:
    r, reach = fit.reach, max(fit.order.ma, default=0)
    index = np.arange(b.at - reach, b.at + b.count)
    noise = b.lagged(0, reach).copy()
    rounds = m["rounds"]
    if not len(rounds):
        for k in range(1, r + 1):
            noise -= m["phi"][k - 1] * b.lagged(k, reach)
    elif len(index) and index[-1] >= r:
        low = max(index[0], r)
        path = _from_start(fit, m["mean"], tuple(m["head"]), tuple(rounds[-1]))
        noise[low - index[0] :] -= path.values(low - r, index[-1] + 1 - low)
    noise[index < r] = 0.0
    use = (b.index >= r) & (b.index < fit.stop)
    rows = [b.own(), *[b.lagged(a) for a in fit.order.ar]]
    rows += [noise[reach - lag : reach - lag + b.count] for lag in fit.order.ma]
    design = np.array(rows)[:, use]
    return (design @ design.T).ravel()


def _states(fit: Fit, b: _Block, m: dict) -> np.ndarray:
    """The block's part in the last errors before ``stop`` and before ``size``, per round."""
    reach, cells = max(fit.order.ma, default=0), []
    for coef in m["rounds"]:
        phi, theta = fit.split(coef)
        u = b.own() - sum((p * b.lagged(k) for k, p in enumerate(phi, 1) if p), np.zeros(b.count))
        u[b.index < fit.reach - 1] = 0.0
        for end in (fit.stop, fit.size):
            part = u[b.index < end]
            if not reach or not len(part):
                cells.append(np.zeros(reach))
                continue
            recursion = _errors(tuple(theta))
            state = np.append(_response(recursion, part, reach), 0.0)
            cells.append((recursion.power(end - b.at - len(part)) @ state)[:reach])
    return np.concatenate(cells) if cells else np.zeros(0)


def _misses(fit: Fit, b: _Block, m: dict) -> np.ndarray:
    """Squared errors over the tail and over the readings not fitted, per round."""
    cells = []
    for k, coef in enumerate(m["rounds"]):
        tail = (b.index >= fit.stop) & (b.index < fit.size)
        rest = np.arange(b.start, b.start + len(b.x)) >= fit.train
        squares = [0.0, 0.0]
        if tail.any():
            phi, theta = fit.split(coef)
            path = Path(phi, theta, m["before"], m["shocks"][2 * k])
            squares[0] = ((b.own()[tail] - path.values(b.index[tail][0] - fit.stop, tail.sum())) ** 2).sum()
        if rest.any():
            path = _forecast(fit, m["mean"], tuple(m["level"]), tuple(coef), tuple(m["shocks"][2 * k + 1]))
            at = b.start + int(rest.argmax())
            squares[1] = ((b.x[rest] - path.values(at - fit.train, rest.sum())) ** 2).sum()
        cells += squares
    return np.array(cells)


@lru_cache(512)
def _errors(theta: tuple) -> Recursion:
    return Recursion(-np.array(theta))


@lru_cache(512)
def _from_start(fit: Fit, mean: float, head: tuple, coef: tuple) -> Path:
    """Path predicted from the first readings: one error can be known, that of the last of them."""
    phi, theta = fit.split(np.array(coef))
    z = np.array(head)
    shock = z[-1] - phi @ z[-2 : -2 - len(phi) : -1] if len(phi) else z[-1]
    return Path(phi, theta, z, np.array([shock]))


@lru_cache(512)
def _forecast(fit: Fit, mean: float, level: tuple, coef: tuple, shocks: tuple) -> Path:
    phi, theta = fit.split(np.array(coef))
    const = mean * (1.0 - phi.sum())
    return Path(fit.integrated(phi), theta, np.array(level), np.array(shocks), const)


def _response(recursion: Recursion, inputs: np.ndarray, count: int) -> np.ndarray:
    """Last ``count`` outputs of the recursion driven by ``inputs`` from rest, zeros before them."""
    reply, n = recursion.impulse(len(inputs)), len(inputs)
    out = np.zeros(count)
    for back in range(min(count, n)):
        out[count - 1 - back] = inputs[: n - back] @ reply[: n - back][::-1]
    return out


# ---- passes --------------------------------------------------------------------------


def _model_of(row, fields: Sequence[str]) -> tuple[Fit, dict]:
    fit = Fit(Order(*[int(row[name]) for name in ORDER]), int(row["_n"]), bool(row[_HELD]))
    return fit, {name: row[name] for name in fields}


def _arrays(value):
    """Nested lists of a column as float arrays."""
    if isinstance(value, np.ndarray | list):
        if len(value) and isinstance(value[0], np.ndarray | list):
            return [np.asarray(v, dtype=float) for v in value]
        return np.asarray(value, dtype=float)
    return value


def _sum(blocks: DataFrame, models: DataFrame, keys: list[str], cells: Callable) -> DataFrame:
    """Sums of ``cells(fit, block, model)`` over the blocks of each model: ``keys, model, held, sums``."""
    fields = [c for c in models.columns if c not in (*keys, WHICH, "_n", *ORDER)]

    @F.pandas_udf("array<double>")
    def part(rows: pd.DataFrame) -> pd.Series:
        out = []
        with np.errstate(all="ignore"):
            for row in rows.to_dict("records"):
                fit, model = _model_of(row, fields)
                model = {name: _arrays(v) for name, v in model.items()}
                block = _Block(fit, int(row["_start"]), row["_back"], row["_x"], model.get("mean") or 0.0)
                out.append(cells(fit, block, model))
        return pd.Series(out)

    beside = models.drop("_n")
    inputs = ["_n", "_start", "_back", "_x", *ORDER, *fields]
    rows = blocks.join(beside, keys).select(*keys, WHICH, _HELD, part(F.struct(*inputs)).alias("_c"))
    ids = [*keys, WHICH, _HELD]
    summed = rows.select(*ids, F.posexplode("_c").alias("_at", "_c")).groupBy(*ids, "_at").agg(F.sum("_c").alias("_c"))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_c")))
    return summed.groupBy(*ids).agg(listed.alias("_l")).select(*ids, F.col("_l._c").alias("sums"))


def _next(
    blocks: DataFrame, models: DataFrame, keys: list[str], cells: Callable, solve: Callable, ddl: str
) -> DataFrame:
    """Models with the columns that ``solve(fit, model, sums)`` gives as a dict, written once."""
    fields = [c for c in models.columns if c not in (*keys, WHICH, "_n", *ORDER)]
    names = [part.split(" ")[0] for part in ddl.split(", ")]

    @F.pandas_udf(ddl)
    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        with np.errstate(all="ignore"):
            for row in rows.to_dict("records"):
                fit, model = _model_of(row, fields)
                sums = np.asarray(row["sums"], dtype=float) if row["sums"] is not None else np.zeros(0)
                out.append(solve(fit, {name: _arrays(v) for name, v in model.items()}, sums))
        return pd.DataFrame(out, columns=names)

    ids = [*keys, WHICH, _HELD]
    with_sums = models.join(_sum(blocks, models, keys, cells), ids, "left")
    kept = [c for c in models.columns if c not in names]
    inputs = ["_n", *ORDER, *fields, "sums"]
    rows = with_sums.select(*kept, solved(F.struct(*inputs)).alias("_s"))
    return stage(rows.select(*kept, "_s.*"), "lag-models")


def _solve_ends(fit: Fit, m: dict, sums: np.ndarray) -> dict:
    r, mean = fit.reach, sums[0] / fit.size
    head, before, level = sums[1 : 1 + r], sums[1 + r : 1 + 2 * r], sums[1 + 2 * r :]
    return {"mean": mean, "head": head - mean, "before": before - mean, "level": level}


def _solve_products(fit: Fit, m: dict, sums: np.ndarray) -> dict:
    return {"phi": arma.yule_walker(sums / fit.size), "rounds": []}


def _solve_round(fit: Fit, m: dict, sums: np.ndarray) -> dict:
    k = len(fit.order.ar) + len(fit.order.ma)
    gram = sums.reshape(k + 1, k + 1)
    coef = arma.solve_limited(gram[1:, 1:], gram[0, 1:])
    return {"rounds": [*[list(c) for c in m["rounds"]], list(coef)]}


def _solve_states(fit: Fit, m: dict, sums: np.ndarray) -> dict:
    reach = max(fit.order.ma, default=0)
    return {"shocks": [list(s) for s in sums.reshape(2 * len(m["rounds"]), reach)]}


def _solve_misses(fit: Fit, m: dict, sums: np.ndarray) -> dict:
    pairs = sums.reshape(len(m["rounds"]), 2)
    score = np.where(np.isnan(pairs[:, 0]), np.inf, pairs[:, 0])
    best = int(score.argmin())
    return {
        "coef": m["rounds"][best],
        "shock": m["shocks"][2 * best + 1],
        "rmse": float(np.sqrt(pairs[best, 1] / fit.tail)) if fit.held else None,
    }


def fitted(
    blocks: DataFrame, keys: Sequence[str], orders: Sequence[Order], held: Sequence[bool] = (False, True)
) -> DataFrame:
    """One row per series, order (``model``: its number) and fit that the series is long enough for.

    ``coef`` (autoregressive lags first), ``mean`` of the differenced series, ``level`` and
    ``shock``: the last readings and errors, which forecasts start from; ``rmse`` of the
    readings that a ``held`` fit left out.
    """
    keys = list(keys)
    kinds = [
        F.struct(
            F.lit(number).alias(WHICH),
            F.lit(kind).alias(_HELD),
            *[F.lit(v).alias(c) for c, v in zip(ORDER, order)],
            F.lit(order.lost).alias("_lost"),
            F.lit(Fit(order, 0, kind).reach).alias("_reach"),
        )
        for number, order in enumerate(orders)
        for kind in held
    ]
    lengths = blocks.groupBy(*keys).agg(F.max("_n").alias("_n"))
    models = lengths.select(*keys, "_n", F.explode(F.array(*kinds)).alias("_k")).select(*keys, "_n", "_k.*")
    # `Fit.valid` in columns.
    tail = F.when(F.col(_HELD), F.floor(F.col("_n") * F.lit(HOLD_OUT))).otherwise(1)
    size = F.col("_n") - F.col("_lost") - F.when(F.col(_HELD), tail).otherwise(0)
    enough = (size > 0) & (tail >= 1) & (size - tail >= 2 * F.col("_reach"))
    models = models.where(enough).drop("_lost", "_reach")
    steps = [(_ends, _solve_ends, "mean double, head array<double>, before array<double>, level array<double>")]
    steps += [(_products, _solve_products, "phi array<double>, rounds array<array<double>>")]
    steps += [(_round, _solve_round, "rounds array<array<double>>")] * (ROUNDS if any(o.ar or o.ma for o in orders) else 1)
    steps += [(_states, _solve_states, "shocks array<array<double>>")]
    steps += [(_misses, _solve_misses, "coef array<double>, shock array<double>, rmse double")]
    for cells, solve, ddl in steps:
        models = _next(blocks, models, keys, cells, solve, ddl)
    return models.drop("head", "before", "phi", "rounds", "shocks")


# ---- forecasts and errors ------------------------------------------------------------


def _spread(fit: Fit, coef: np.ndarray, start: int, count: int, shift: int) -> np.ndarray:
    """Root of the running sum of squared weights at steps ``start ..``.

    Weights follow ``w_k = theta_k + sum phi_j w_{k-j}``, w_0 = 1; ``shift`` moves coefficients later.
    """
    phi, theta = fit.split(coef)
    pad = np.zeros(shift)
    phi, theta = np.append(pad, phi) if len(phi) else phi, np.append(pad, theta) if len(theta) else theta
    # Two shocks' worth of history: the weight at step 0 is the recursion's last value.
    path = Path(phi, theta, np.array([1.0]), np.array([1.0]))
    earlier = 1.0 + path.squares(start - 1) if start else 0.0
    weights = path.values(start - 1, count) if start else np.append(1.0, path.values(0, count - 1))
    return np.sqrt(earlier + np.cumsum(weights**2))


def predicted(shift: int = 0) -> Column:
    """``struct<yhat, spread>`` of arrays for ``_count`` steps from the ``_from``-th on after the fitted readings.

    NaN where ``coef`` is null.
    """

    @F.pandas_udf("yhat array<double>, spread array<double>")
    def paths(rows: pd.DataFrame) -> pd.DataFrame:
        yhat, spread = [], []
        with np.errstate(all="ignore"):
            for row in rows.to_dict("records"):
                start, count = int(row["_from"]), int(row["_count"])
                if row["coef"] is None:
                    yhat.append(np.full(count, np.nan))
                    spread.append(yhat[-1])
                    continue
                fit, m = _model_of(row, ["mean", "level", "coef", "shock"])
                coef = np.asarray(m["coef"], float)
                path = _forecast(fit, m["mean"], tuple(m["level"]), tuple(coef), tuple(m["shock"]))
                yhat.append(path.values(start, count))
                spread.append(_spread(fit, coef, start, count, shift))
        return pd.DataFrame({"yhat": yhat, "spread": spread})

    inputs = ["_n", _HELD, *ORDER, "mean", "level", "coef", "shock", "_from", "_count"]
    return paths(F.struct(*inputs))


def _own_errors(fit: Fit, b: _Block, m: dict) -> tuple[np.ndarray, Recursion | None]:
    phi, theta = fit.split(m["coef"])
    u = b.own() - sum((p * b.lagged(k) for k, p in enumerate(phi, 1) if p), np.zeros(b.count))
    u[b.index < fit.reach - 1] = 0.0
    if not len(theta):
        return u, None
    recursion = _errors(tuple(theta))
    return np.convolve(u, recursion.impulse(len(u)))[: len(u)], recursion


def error_squares(blocks: DataFrame, models: DataFrame, keys: Sequence[str], since: int) -> DataFrame:
    """``keys, model, n_errors, squares`` of the one-step errors from position ``since`` on, for full fits.

    A block gives its errors from rest, which its true start changes linearly; so it reports
    their squares, their products with the effect of a start, and its own last errors.
    Starts are then put together along the blocks' small rows by doubling.
    """
    keys = list(keys)
    fields = [_HELD, "mean", "coef"]

    @F.pandas_udf(
        "theta array<double>, end array<double>, own int, count long, squares double, mixed array<double>, effect array<double>"
    )
    def part(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        with np.errstate(all="ignore"):
            for row in rows.to_dict("records"):
                fit, m = _model_of(row, fields)
                m = {name: _arrays(v) for name, v in m.items()}
                b = _Block(fit, int(row["_start"]), row["_back"], row["_x"], m["mean"])
                e, recursion = _own_errors(fit, b, m)
                use = b.index >= since
                reach = recursion.size if recursion else 0
                basis = recursion.basis(b.count)[:, :reach] if reach and b.count else np.zeros((b.count, reach))
                end = np.append(np.zeros(reach), e)[len(e) :]
                seen = basis[use]
                theta = fit.split(m["coef"])[1]
                row = (theta, end, len(e), int(use.sum()), float(e[use] @ e[use]), e[use] @ seen, (seen.T @ seen).ravel())
                out.append(row)
        return pd.DataFrame(out, columns=["theta", "end", "own", "count", "squares", "mixed", "effect"])

    inputs = ["_n", "_start", "_back", "_x", *ORDER, *fields]
    ids = [*keys, WHICH]
    rows = blocks.join(models.where(~F.col(_HELD)).select(*ids, *ORDER, *fields), keys)
    rows = rows.select(*ids, "_blk", F.size("_x").alias("_len"), part(F.struct(*inputs)).alias("_p"))
    started = starts(stage(rows.select(*ids, "_blk", "_len", "_p.*"), "error-parts"), ids)

    @F.pandas_udf("double")
    def whole(rows: pd.DataFrame) -> pd.Series:
        out = []
        with np.errstate(all="ignore"):
            for row in rows.to_dict("records"):
                s = np.asarray(row["_state"], float)
                effect = np.asarray(row["effect"], float).reshape(len(s), len(s))
                out.append(row["squares"] + 2 * s @ np.asarray(row["mixed"], float) + s @ effect @ s)
        return pd.Series(out, dtype=float)

    each = started.select(*ids, "count", whole(F.struct("_state", "squares", "mixed", "effect")).alias("_q"))
    return each.groupBy(*ids).agg(F.sum("count").alias("n_errors"), F.sum("_q").alias("squares"))


def starts(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Blocks with ``_state``, the errors before them, from ``end``, the errors each makes from rest.

    ``theta`` are the coefficients by lag, ``own`` a block's errors, ``_len`` its readings.
    After k steps a block's ``end`` stands for the 2^k blocks up to it.  All blocks but the
    first and the last of a series have one length, so a step is one matrix per model.
    """
    along = Window.partitionBy(*ids).orderBy("_blk")
    last = rows.agg(F.max("_blk")).first()[0] or 0

    def combined(k: int):
        @F.pandas_udf("array<double>")
        def add(rows: pd.DataFrame) -> pd.Series:
            out = []
            with np.errstate(all="ignore"):
                for row in rows.to_dict("records"):
                    end, earlier = np.asarray(row["end"], float), row["_earlier"]
                    if earlier is not None and len(end):
                        # This block's own errors, then whole blocks before it.
                        steps = int(row["own"]) + int(row["_full"]) * ((1 << k) - 1)
                        power = _errors(tuple(row["theta"])).power(steps)
                        end = end + (power @ np.append(earlier, 0.0))[:-1]
                    out.append(end)
            return pd.Series(out)

        return add

    rows = rows.withColumn("_full", F.max("_len").over(Window.partitionBy(*ids)))
    for k in range(int(last).bit_length()):
        rows = rows.withColumn("_earlier", F.lag("end", 1 << k).over(along))
        rows = rows.withColumn("end", combined(k)(F.struct("theta", "end", "_earlier", "own", "_full")))
    blank = F.transform("end", lambda _: F.lit(0.0))
    return rows.withColumn("_state", F.coalesce(F.lag("end", 1).over(along), blank))


def residual_rows(
    blocks: DataFrame, keys: Sequence[str], phi: np.ndarray, theta: np.ndarray
) -> DataFrame:
    """Blocks with ``_e``, the one-step errors of fixed coefficients by lag; zero before the longest lag."""
    first = max(len(phi), len(theta))

    @F.pandas_udf("theta array<double>, end array<double>, own int, rest array<double>")
    def part(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        recursion = _errors(tuple(theta))
        for start, back, x in zip(rows["_start"], rows["_back"], rows["_x"]):
            values = np.concatenate([np.zeros(max(len(phi) - len(back), 0)), back, x])
            n, at = len(x), len(values) - len(x)
            u = values[at:] - sum((c * values[at - k : at - k + n] for k, c in enumerate(phi, 1) if c), np.zeros(n))
            u[start + np.arange(n) < first] = 0.0
            e = np.convolve(u, recursion.impulse(n))[:n] if len(theta) else u
            out.append((theta, np.append(np.zeros(len(theta)), e)[n:], n, e))
        return pd.DataFrame(out, columns=["theta", "end", "own", "rest"])

    @F.pandas_udf("array<double>")
    def added(rest: pd.Series, state: pd.Series) -> pd.Series:
        recursion = _errors(tuple(theta))
        pairs = zip(rest, state)
        return pd.Series([e + recursion.basis(len(e))[:, : len(theta)] @ s if len(s) else e for e, s in pairs])

    rows = blocks.withColumn("_p", part(F.struct("_start", "_back", "_x")))
    rows = stage(rows.select(*blocks.columns, F.size("_x").alias("_len"), "_p.*"), "error-parts")
    small = starts(rows.select(*keys, "_blk", "_len", "theta", "end", "own"), keys).select(*keys, "_blk", "_state")
    return rows.join(small, [*keys, "_blk"]).withColumn("_e", added("rest", "_state"))
