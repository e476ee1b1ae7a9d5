"""Row-wise operators: keys, values, calendar parts, day filters, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.calendar import DAYSLOT_ORIGIN, day_number


def assign_key(df: DataFrame, key: str, value: Any = None) -> DataFrame:
    """Attach a constant key, and optionally a new value; timestamps stay."""
    out = df.withColumn("key", F.lit(key))
    return out if value is None else with_value(out, value)


def with_value(df: DataFrame, value: Column | Any) -> DataFrame:
    """Replace the value of every point, keeping key and timestamp."""
    return df.withColumn("value", value if isinstance(value, Column) else F.lit(value))


def calendar_expand(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add year, month (0-based), day, dow (1 = Sunday), hour and minute."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts) - 1,
            "day": F.dayofmonth(ts),
            "dow": F.dayofweek(ts),
            "hour": F.hour(ts),
            "minute": F.minute(ts),
        }
    )


def filter_day(df: DataFrame, day: int, ts: str = "ts") -> DataFrame:
    """Readings of one weekday, 1 = Sunday .. 7 = Saturday."""
    return df.where(F.dayofweek(ts) == day)


def filter_key(df: DataFrame, key: str, column: str = "key") -> DataFrame:
    return df.where(F.col(column) == key)


def select_days(
    df: DataFrame,
    start_day: int,
    n_days: int,
    weeks: int = 1,
    last_only: bool = False,
    ts: str = "ts",
    origin: str = DAYSLOT_ORIGIN,
    day_base: int = 1,
) -> DataFrame:
    """Day windows ``start .. start+n_days`` (both ends included), one per week.

    Window w starts 7*w days later.  Windows overlap when ``n_days >= 7``, and a
    row then appears once per window it lies in, marked by ``week``.  With
    ``last_only`` only the last window is returned.
    """
    after = day_number(ts, origin, day_base) - F.lit(start_day)
    first = F.greatest(F.ceil((after - n_days) / 7), F.lit(weeks - 1 if last_only else 0))
    last = F.least(F.floor(after / 7), F.lit(weeks - 1))
    return (
        df.withColumns({"_first": first.cast("int"), "_last": last.cast("int")})
        .where("_first <= _last")
        .withColumn("week", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def union_series(*series: DataFrame) -> DataFrame:
    """All rows of several series, columns matched by name."""
    return reduce(DataFrame.unionByName, series)


def dedupe(df: DataFrame, keys: Sequence[str] = ("key", "ts"), value: str = "value") -> DataFrame:
    """One row per key and timestamp, repeated readings summed."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))
