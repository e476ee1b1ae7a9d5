"""Hour-of-week profiles, and readings set against them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.blocks import TIME_BLOCK, spread_join, time_block


def periodic_index(
    index: DataFrame, mode: str = "mean", ts: str = "ts", value: str = "ri"
) -> DataFrame:
    """Profile ``(key, dow, hour, pi)`` from a raw index.

    ``mean``: the mean per weekday and hour.  ``last_cycle``: half the value of
    the last week at that weekday and hour.  Both are plain aggregates that
    combine before the shuffle; 168 rows per key come out.
    """
    aggregates = {
        "mean": F.avg(value),
        "last_cycle": F.max_by(value, ts) * 0.5,
    }
    return index.groupBy(
        "key", F.dayofweek(ts).alias("dow"), F.hour(ts).alias("hour")
    ).agg(aggregates[mode].alias("pi"))


def normalize_index(profile: DataFrame, as_written: bool = False) -> DataFrame:
    """Scale each weekday of a profile to sum to 24.

    ``as_written`` divides hour 1..24 by that many daily sums, the effect of a
    running sum that is never reset.
    """
    day = Window.partitionBy("key", "dow")
    total = F.sum("pi").over(day)
    if as_written:
        total = total * (F.col("hour") + 1)
    return profile.withColumn("pi", F.try_divide(24 * F.col("pi"), total))


def pack_profile(profile: DataFrame) -> DataFrame:
    """``(profile_key, dow, pis)``: 24 entries per weekday, null where there is none."""
    hours = ", ".join(f"max(pi) FILTER (WHERE hour = {h})" for h in range(24))
    return profile.groupBy(F.col("key").alias("profile_key"), "dow").agg(
        F.expr(f"array({hours})").alias("pis")
    )


def with_profile(
    readings: DataFrame,
    profile: DataFrame,
    pairs: DataFrame | None = None,
    ts: str = "ts",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Readings with ``profile_key``, ``dow`` and ``pi``, the profile entry of their hour.

    Without ``pairs`` each key meets its own profile.  ``pairs(key, profile_key)``
    lists which profiles a key is set against.  A profile travels as seven rows,
    and is spread over the key's time blocks before the join.
    """
    packed = pack_profile(profile)
    if pairs is None:
        packed = packed.withColumn("key", F.col("profile_key"))
    else:
        packed = pairs.select("key", "profile_key").distinct().join(packed, "profile_key")
    joined = spread_join(
        readings.withColumn("dow", F.dayofweek(ts)),
        packed,
        ["key"],
        time_block(ts, block),
        also=["dow"],
    )
    return joined.withColumn("pi", F.get("pis", F.hour(ts))).drop("pis")


def _against_profile(
    readings: DataFrame,
    profile: DataFrame,
    pairs: DataFrame | None,
    name: str,
    formula: Column,
    keep: Column,
    ts: str,
    block: str | timedelta,
) -> DataFrame:
    return (
        with_profile(readings, profile, pairs, ts, block)
        .where(keep)
        .select("key", "profile_key", ts, "dow", formula.alias(name))
    )


def peaks(
    readings: DataFrame,
    profile: DataFrame,
    pairs: DataFrame | None = None,
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """``peak = value - pi`` for every reading whose hour has a profile entry."""
    pi = F.col("pi")
    return _against_profile(
        readings, profile, pairs, "peak", F.col(value) - pi, pi.isNotNull(), ts, block
    )


def adjusted_series(
    readings: DataFrame,
    profile: DataFrame,
    pairs: DataFrame | None = None,
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """``adjusted = value / pi``; readings whose entry is zero or missing drop out."""
    pi = F.col("pi")
    return _against_profile(
        readings, profile, pairs, "adjusted", F.col(value) / pi, pi != 0, ts, block
    )
