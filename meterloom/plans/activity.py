"""Activity profiles from weather readings, and synthetic series from profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from meterloom.operators.synth import synth_readings
from meterloom.operators.thermal import (
    GROUP,
    activity_profile,
    activity_residual,
    fit_thermal_ar,
    lag_features,
)
from meterloom.session import stage


def train_activity(
    weather: DataFrame,
    as_arrays: bool = True,
    group: Sequence[str] = GROUP,
    staged: bool = True,
) -> DataFrame:
    """Regression per meter and hour, temperature effect removed, profile of the rest.

    The readings are passed over three times, so they are written to the shared folder
    first; ``staged=False`` leaves that out, for readings that are a table already.
    """
    if staged:
        weather = stage(weather, "weather")
    models = fit_thermal_ar(lag_features(weather, group), group)
    return activity_profile(activity_residual(weather, models, group), as_arrays, group)


def generate(
    ids: DataFrame,
    weather: DataFrame,
    seed_temperature: DataFrame,
    start_date: str,
    days: int,
    peaky_ratio: float,
    **options,
) -> DataFrame:
    """Synthetic series for ``ids`` from the profiles of ``weather``.

    The profiles are written to the shared folder between training and generation.
    """
    activity = stage(train_activity(weather), "activity")
    return synth_readings(
        ids, activity, seed_temperature, start_date, days, peaky_ratio, **options
    )
