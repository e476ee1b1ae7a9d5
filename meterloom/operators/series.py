"""Algebra on whole series: sums, differences, centring, covariances.

Series are cut into time blocks (`pack`); positions and lags reach across block
edges, so a series may be longer than one task can hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from itertools import combinations_with_replacement
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.blocks import (
    ROW_BLOCK,
    TIME_BLOCK,
    duration_us,
    pack,
    running_total,
    time_block,
)


#: Readings a difference may reach back by copies at block edges; farther ones are re-keyed.
NEAR = 48


def hourly_sum(
    readings: DataFrame,
    slot_label: str = "pair",
    slot: str | timedelta = "30 minutes",
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Sum of the half hours of each hour: ``(key, date, dow, hour, value)``, hour 1..24.

    Readings stamped at the end of their slot (``slot_label='end'``) are moved
    back by one slot first, so slots 1 and 2 always form hour 1.
    """
    start = F.col(ts).cast("timestamp")
    if slot_label == "end":
        start = F.timestamp_micros(F.unix_micros(start) - duration_us(slot))
    elif slot_label != "pair":
        raise ValueError("slot_label is 'end' or 'pair'")
    return (
        readings.withColumn("_start", start)
        .groupBy(
            "key",
            F.to_date("_start").alias("date"),
            F.dayofweek("_start").alias("dow"),
            (F.hour("_start") + 1).alias("hour"),
        )
        .agg(F.sum(value).alias("value"))
    )


def difference(
    series: DataFrame,
    lag: int = 1,
    times: int = 1,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Add ``i`` and ``diff``, the difference at ``lag`` taken ``times`` times.

    The first ``lag * times`` rows keep their value and have a null ``diff``: they
    are the initial values that `integrate` starts from.  A null value makes the
    differences it enters null.  Far lags are reached by re-keying: each reading goes to
    every position whose difference it enters, one shuffle whatever the lag.
    """
    blocks = pack(series, keys, [ts], time_block(ts, block))
    factors = [float((-1) ** j * comb(times, j)) for j in range(times + 1)]
    if lag * times > NEAR:
        return _far_difference(blocks.rows(), series.columns, lag, factors, keys, value)
    shifts = {f"_x{j}": (value, j * lag) for j in range(1, times + 1)}
    diff = F.col(value)
    for j in range(1, times + 1):
        diff = diff + F.lit(factors[j]) * F.col(f"_x{j}")
    return (
        blocks.shifted(shifts)
        .withColumn("diff", F.when(F.col("i") >= lag * times, diff))
        .select(*series.columns, "i", "diff")
    )


def _far_difference(
    rows: DataFrame, columns: list[str], lag: int, factors: list[float], keys: Sequence[str], value: str
) -> DataFrame:
    own = F.struct(*[c for c in columns if c not in keys])
    terms = [
        F.struct(
            (F.col("i") + j * lag).alias("i"),
            (F.lit(factor) * F.col(value)).alias("term"),
            (own if j == 0 else F.lit(None)).alias("row"),
        )
        for j, factor in enumerate(factors)
    ]
    sent = rows.select(*keys, F.explode(F.array(*terms)).alias("_t")).select(*keys, "_t.*")
    met = sent.groupBy(*keys, "i").agg(
        F.sum("term").alias("_sum"), F.count("term").alias("_met"), F.any_value("row", True).alias("_row")
    )
    # Positions beyond the end have no reading of their own.
    whole = F.when(F.col("_met") == len(factors), F.col("_sum"))
    return met.where(F.col("_row").isNotNull()).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns], "i", whole.alias("diff")
    )


def integrate(
    differenced: DataFrame,
    lag: int = 1,
    keys: Sequence[str] = ("key",),
    initial: str = "value",
    diff: str = "diff",
    out: str = "integrated",
    width: int = ROW_BLOCK,
    times: int = 1,
) -> DataFrame:
    """Inverse of `difference` at ``lag`` taken ``times`` times, from its first ``lag * times`` values.

    Positions congruent modulo ``lag`` form a chain of its own: the initial values give
    the chain's first differences, and ``times`` running totals undo the differencing.
    A null difference counts as no change for what follows and is null itself; so is an
    unknown initial value.
    """
    chained = differenced.withColumns(
        {"_chain": F.pmod(F.col("i"), F.lit(lag)), "_k": F.expr(f"i div {int(lag)}")}
    )
    # Differences of the initial values as if zeros preceded them.
    first = Window.partitionBy(*keys, "_chain").orderBy("_k")
    start = F.col(initial).cast("double")
    for j in range(1, times):
        factor = float((-1) ** j * comb(times, j))
        start = start + F.lit(factor) * F.coalesce(F.lag(initial, j).over(first), F.lit(0.0))
    if times > 1:
        heads = chained.where(F.col("_k") < times).withColumn("_step", start)
        rest = chained.where(F.col("_k") >= times).withColumn("_step", F.col(diff).cast("double"))
        steps = heads.unionByName(rest)
    else:
        steps = chained.withColumn("_step", F.when(F.col("_k") < 1, start).otherwise(F.col(diff)))
    summed = running_total(steps, [*keys, "_chain"], "_k", "_step", out, width, times)
    return summed.drop("_chain", "_k", "_step")


def center(
    series: DataFrame,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Add ``mean`` of the series' values, nulls left out, and ``centered = value - mean``."""
    blocks = pack(series, keys, [ts], time_block(ts, block), totals={"_sum": value})
    return (
        blocks.rows()
        .withColumn("mean", F.when(F.col("_sum_n") > 0, F.col("_sum") / F.col("_sum_n")))
        .withColumn("centered", F.col(value) - F.col("mean"))
        .select(*series.columns, "mean", "centered")
    )


def autocovariance(
    series: DataFrame,
    max_lag: int,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """``(keys, n, acov)`` with the biased autocovariances of lag 0..max_lag.

    ``r_j = sum(x_i * x_{i+j}) / n`` on the centred series; ``n`` counts the values, and
    products with a null are left out.
    """
    lags = range(1, max_lag + 1)
    blocks = pack(
        series.select(*keys, ts, value), keys, [ts], time_block(ts, block), totals={"_sum": value}
    )
    rows = blocks.shifted({f"_x{j}": (value, j) for j in lags})
    mean = F.when(F.col("_sum_n") > 0, F.col("_sum") / F.col("_sum_n"))
    x = F.col(value) - mean
    sums = [F.sum(x * x)]
    sums += [F.coalesce(F.sum(x * (F.col(f"_x{j}") - mean)), F.lit(0.0)) for j in lags]
    count = F.count(F.col(value))
    return rows.groupBy(*keys).agg(
        count.alias("n"), F.array(*[F.when(count > 0, s / count) for s in sums]).alias("acov")
    )


def series_stats(
    series: DataFrame, keys: Sequence[str] = ("key",), value: str = "value"
) -> DataFrame:
    """Count, minimum, mean, population standard deviation and sample variance."""
    return series.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.var_samp(value).alias("variance"),
    )


def rmse(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = ("key", "ts"),
    keys: Sequence[str] = ("key",),
    left_value: str = "value",
    right_value: str = "value",
) -> DataFrame:
    """Root mean squared error per key between series aligned on ``on``."""
    a = left.select(*on, F.col(left_value).alias("_a"))
    b = right.select(*on, F.col(right_value).alias("_b"))
    error = F.col("_a") - F.col("_b")
    return (
        a.join(b, list(on))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))
    )


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of all products of two columns per key, as ``g_<a>_<b>``.

    These sufficient statistics of a least-squares fit combine before the
    shuffle, so the rows of a group are never brought together.
    """
    return df.groupBy(*keys).agg(
        *[
            F.sum(F.col(a) * F.col(b)).alias(f"g_{a}_{b}")
            for a, b in combinations_with_replacement(columns, 2)
        ]
    )
