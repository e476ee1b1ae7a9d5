"""Temperature-aware regression per meter and hour, and activity profiles.

Each (meter, hour) regresses the reading on the three previous days' readings at
that hour and on three temperature hinges.  The rows are reduced to sums of
products by Spark; only one 8 x 8 matrix per group reaches Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.blocks import pack, spread_join, whole_div
from meterloom.operators.series import gram

# Hinge temperatures of the regression.
HOT, COOL, COLD = 20.0, 16.0, 5.0

GROUP = ("meter_id", "hour")
PREDICTORS = ("lag1", "lag2", "lag3", "over", "under", "frost")
_DAYS_PER_BLOCK = 1024
_RANK_TOLERANCE = 1e-12
_FIT_TYPE = T.StructType(
    [
        T.StructField("beta", T.ArrayType(T.DoubleType())),
        T.StructField("regular", T.BooleanType()),
    ]
)


def hinges(temperature: str = "temperature") -> dict[str, Column]:
    """Degrees above 20, below 16 and below 5."""
    t, zero = F.col(temperature).cast("double"), F.lit(0.0)
    return {
        "over": F.greatest(t - HOT, zero),
        "under": F.greatest(F.lit(COOL) - t, zero),
        "frost": F.greatest(F.lit(COLD) - t, zero),
    }


def date_block(date: str = "date", days: int = _DAYS_PER_BLOCK) -> Column:
    return whole_div(F.unix_date(date), days)


def lag_features(weather: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Regression rows: the reading, its three predecessors and the hinges.

    Predecessors are the previous rows of the (meter, hour) by date, whether or not
    days are missing; the first three rows of a group make no regression row.
    """
    blocks = pack(weather, group, ["date", "reading"], date_block())
    lagged = blocks.shifted({f"lag{k}": ("reading", k) for k in (1, 2, 3)})
    return lagged.where(F.col("i") >= 3).withColumns(hinges()).drop("i", "n", "_b")


def _solve_normal_equations(products: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and full-rank flags for a stack of packed cross-product matrices."""
    rows, cols = np.triu_indices(size)
    full = np.zeros((len(products), size, size))
    full[:, rows, cols] = products
    full[:, cols, rows] = products
    lhs, rhs = full[:, :-1, :-1], full[:, :-1, -1]
    norm = np.sqrt(np.einsum("kii->ki", lhs))
    filled = (norm > 0).all(axis=1)
    norm[~filled] = 1.0
    scaled = lhs / (norm[:, :, None] * norm[:, None, :])
    scaled[~filled] = np.eye(size - 1)
    regular = filled & (np.linalg.eigvalsh(scaled)[:, 0] > _RANK_TOLERANCE)
    scaled[~regular] = np.eye(size - 1)
    beta = np.linalg.solve(scaled, (rhs / norm)[:, :, None])[:, :, 0] / norm
    beta[~regular] = 0.0
    return beta, regular


@F.pandas_udf(_FIT_TYPE)
def _fit(products: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in products:
        stack = np.array(batch.tolist(), dtype=float)
        size = int((np.sqrt(8 * stack.shape[1] + 1) - 1) / 2)
        beta, regular = _solve_normal_equations(stack, size)
        yield pd.DataFrame({"beta": list(beta), "regular": regular})


def fit_thermal_ar(features: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Least squares with intercept per group: ``(group, n, beta, status)``.

    ``beta`` holds the intercept and the coefficients of `PREDICTORS`.  Groups with
    fewer rows than parameters (``short``) or collinear columns (``singular``)
    get all zeros.  Collinear means a scaled normal matrix with an eigenvalue
    under 1e-12, so groups that are singular only up to rounding count too.
    """
    columns = ["one", *PREDICTORS, "reading"]
    sums = gram(features.withColumn("one", F.lit(1.0)), group, columns)
    packed = sums.select(
        *group,
        F.col("g_one_one").cast("long").alias("n"),
        F.array(*[f"g_{a}_{b}" for a, b in combinations_with_replacement(columns, 2)]).alias("g"),
    ).withColumn("fit", _fit("g"))
    short = F.col("n") < len(columns) - 1
    zeros = F.array(*[F.lit(0.0)] * (len(columns) - 1))
    return packed.select(
        *group,
        "n",
        F.when(short, zeros).otherwise(F.col("fit.beta")).alias("beta"),
        F.when(short, "short")
        .when(~F.col("fit.regular"), "singular")
        .otherwise("ok")
        .alias("status"),
    )


def activity_residual(
    weather: DataFrame, models: DataFrame, group: Sequence[str] = GROUP
) -> DataFrame:
    """Add ``activity``: the reading less the temperature terms of its model.

    The autoregressive terms stay in.
    """
    hinge = hinges()
    part = lambda k, name: F.element_at("beta", k) * hinge[name]
    joined = spread_join(weather, models.select(*group, "beta"), group, date_block())
    thermal = part(5, "over") + part(6, "under") + part(7, "frost")
    return joined.withColumn("activity", F.col("reading") - thermal).drop("beta")


def activity_profile(
    residual: DataFrame, as_arrays: bool = False, group: Sequence[str] = GROUP
) -> DataFrame:
    """Mean and population standard deviation of activity per meter and hour.

    ``as_arrays`` gives one row per meter with two 24-entry arrays, 0.0 for hours
    without readings.
    """
    long = residual.groupBy(*group).agg(
        F.avg("activity").alias("mean"), F.stddev_pop("activity").alias("std")
    )
    if not as_arrays:
        return long
    meter, hour = group
    cells = long.groupBy(meter).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(hour).cast("int"), "mean"))).alias("m"),
        F.map_from_entries(F.collect_list(F.struct(F.col(hour).cast("int"), "std"))).alias("s"),
    )
    slots = F.sequence(F.lit(0), F.lit(23))
    fill = lambda c: F.transform(
        slots, lambda h: F.coalesce(F.try_element_at(c, h), F.lit(0.0))
    )
    return cells.select(meter, fill("m").alias("mean"), fill("s").alias("std"))
