"""Readings to de-seasonalised forecasts with their peaks."""

from __future__ import annotations

from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame

from meterloom.functions.arma import Order
from meterloom.operators.combine import add_peaks
from meterloom.operators.forecast import DEFAULT_ORDER, forecast_arima
from meterloom.operators.profile import adjusted_series, peaks, periodic_index
from meterloom.operators.smooth import raw_index
from meterloom.session import stage
from meterloom.sources.grid import gap_fill


class Decomposition(NamedTuple):
    """The stages of `decompose`; only those that are used get computed."""

    readings: DataFrame
    index: DataFrame
    profile: DataFrame
    peaks: DataFrame
    adjusted: DataFrame
    forecast: DataFrame
    combined: DataFrame


def decompose(
    readings: DataFrame,
    pairs: DataFrame | None = None,
    combos: DataFrame | None = None,
    order: Order = DEFAULT_ORDER,
    period: str | timedelta = "30 minutes",
    staged: bool = True,
) -> Decomposition:
    """Profile, peaks, adjusted series, forecasts per weekday, and their sum.

    The gap-filled readings, the profile and the adjusted series are written to the
    shared folder once, since several later stages start from each of them.  With
    ``staged=False`` everything stays one lazy plan that repeats their work.
    """
    keep = stage if staged else (lambda df, name: df)
    filled = keep(gap_fill(readings, period), "readings")
    index = raw_index(filled, slide=period)
    profile = keep(periodic_index(index), "profile")
    tops = peaks(filled, profile, pairs)
    adjusted = keep(adjusted_series(filled, profile, pairs), "adjusted")
    forecast = forecast_arima(adjusted, order)
    return Decomposition(
        filled, index, profile, tops, adjusted, forecast, add_peaks(forecast, tops, combos)
    )
