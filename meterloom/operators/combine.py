"""Forecasts set back onto peaks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.blocks import TIME_BLOCK, spread_join, time_block

# Measurement names of the four live combinations, forecast of the first series on
# its own profile with each peak set: own, own by the second profile, second, second by own.
MEASUREMENTS = ("addpeaks1", "addpeaks2", "addpeaks3", "addpeaks4")
_COMBO = ("f_key", "f_profile", "p_key", "p_profile")


def paired_forecast(
    forecast: DataFrame,
    combos: DataFrame | None = None,
    ts: str = "ts",
    block: str | timedelta = TIME_BLOCK,
) -> tuple[DataFrame, list[str]]:
    """Forecast rows with the peak set ``p_key, p_profile`` they meet, and the extra columns of ``combos``."""
    f = forecast.select(
        F.col("key").alias("f_key"), F.col("profile_key").alias("f_profile"), ts, "yhat"
    )
    if combos is None:
        return f.withColumns({"p_key": F.col("f_key"), "p_profile": F.col("f_profile")}), []
    extra = [c for c in combos.columns if c not in _COMBO]
    return spread_join(f, combos, ["f_key", "f_profile"], time_block(ts, block)), extra


def add_peaks(
    forecast: DataFrame,
    peaks: DataFrame,
    combos: DataFrame | None = None,
    ts: str = "ts",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Forecast plus peak at equal times; key and time are those of the peak.

    ``combos(f_key, f_profile, p_key, p_profile)`` lists which forecast meets which
    peak set, with any further columns (such as a measurement name) kept.
    Without it every forecast meets its own peaks.  A series without a forecast (too
    short) keeps its rows, with a null ``value``.  The join is on series and
    time, so it spreads evenly however long one series is.
    """
    paired, extra = paired_forecast(forecast, combos, ts, block)
    p = peaks.select(
        F.col("key").alias("p_key"), F.col("profile_key").alias("p_profile"), ts, "dow", "peak"
    )
    met = paired.join(p.withColumn("_met", F.lit(True)), ["p_key", "p_profile", ts], "left")
    return met.where(F.col("_met") | F.col("yhat").isNull()).select(
        *extra,
        "f_key",
        "f_profile",
        F.col("p_key").alias("key"),
        F.col("p_profile").alias("profile_key"),
        ts,
        "dow",
        (F.col("yhat") + F.col("peak")).alias("value"),
    )
