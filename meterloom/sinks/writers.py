"""Sinks.  Each ``to_*`` is a plain DataFrame; each ``write_*`` writes it out in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions import text


#: Points of one request to a time-series store, fixed value.
BATCH_POINTS = 2000


def _measurement(measurement: str | Column) -> Column:
    return F.lit(measurement) if isinstance(measurement, str) else measurement


def points(df: DataFrame, measurement: str | Column, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(measurement, key, ts_ms, value)``, the tagged points of a time-series store."""
    return df.select(
        _measurement(measurement).alias("measurement"),
        "key",
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"),
        F.col(value).cast("double").alias("value"),
    )


def write_points(
    df: DataFrame,
    path: str,
    measurement: str | Column,
    ts: str = "ts",
    value: str = "value",
    mode: str = "append",
) -> None:
    """Points as parquet, one folder per measurement."""
    points(df, measurement, ts, value).write.mode(mode).partitionBy("measurement").parquet(path)


def to_line_protocol(
    df: DataFrame,
    measurement: str | Column,
    ts: str = "ts",
    value: str = "value",
    value_format: str | None = None,
) -> DataFrame:
    """Points as time-series line text in column ``value``."""
    line = text.line_protocol(_measurement(measurement), "key", ts, value, value_format)
    return df.select(line.alias("value"))


def write_line_protocol(df: DataFrame, path: str, measurement: str | Column, **options) -> None:
    to_line_protocol(df, measurement, **options).write.text(path)


def write_line_batches(
    df: DataFrame,
    path: str,
    measurement: str | Column,
    points_per_file: int = BATCH_POINTS,
    mode: str = "append",
    **options,
) -> None:
    """Line text in files of at most ``points_per_file`` points, one request's worth each.

    Files appear when the whole write is committed: a task that is repeated or a job that
    fails leaves no point twice and none of a part.
    """
    lines = to_line_protocol(df, measurement, **options)
    lines.write.mode(mode).option("maxRecordsPerFile", points_per_file).text(path)


def point_to_csv(
    df: DataFrame, ts: str = "ts", value: str = "value", value_format: str | None = None
) -> DataFrame:
    """Points as ``time,key,value`` text in column ``value``."""
    return df.select(text.point_csv(ts, "key", value, value_format).alias("value"))


def to_activity_lines(activity: DataFrame, meter: str = "meter_id") -> DataFrame:
    """Activity profiles in array form as text lines in column ``value``."""
    return activity.select(text.activity_line(meter).alias("value"))


def write_activity(activity: DataFrame, path: str, meter: str = "meter_id") -> None:
    to_activity_lines(activity, meter).write.text(path)


def to_synthetic_lines(synthetic: DataFrame) -> DataFrame:
    """Synthetic readings as text lines in column ``value``."""
    return synthetic.select(text.synthetic_line().alias("value"))


def write_synthetic(synthetic: DataFrame, path: str) -> None:
    to_synthetic_lines(synthetic).write.text(path)
