"""Readings as they arrive to tagged points of every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.streaming.streams import (
    stream_add_peaks,
    stream_adjusted,
    stream_moving_average,
    stream_peaks,
    stream_raw_index,
)
from meterloom.streaming.writers import write_stream, write_stream_points


def stream_decompose(
    readings: DataFrame,
    profile: DataFrame,
    forecast: DataFrame,
    path: str,
    checkpoint: str,
    pairs: DataFrame | None = None,
    combos: DataFrame | None = None,
    align_minutes: int | None = None,
    rejects: DataFrame | None = None,
    available_now: bool = True,
) -> list[StreamingQuery]:
    """Start the streaming counterpart of `decompose`; returns its queries.

    ``profile`` and ``forecast`` are stored tables of earlier readings.  Every stage is a
    query of its own, with its points in a folder under ``path`` and its progress in one under
    ``checkpoint``, so one that fails or falls behind leaves the others alone: ``average``,
    ``index``, ``peaks``, ``adjusted``, ``combined``, and ``rejects`` where given.  Points are
    measured as their folder, those of ``combined`` as the ``measurement`` of ``combos``
    where it has one.  A series by another one's profile has the key ``key/profile_key``.
    """

    def named(df: DataFrame) -> DataFrame:
        if "profile_key" not in df.columns:
            return df
        both = F.concat_ws("/", "key", "profile_key")
        own = F.col("key") == F.col("profile_key")
        return df.withColumn("key", F.when(own, F.col("key")).otherwise(both))

    tops = stream_peaks(readings, profile, pairs)
    combined = stream_add_peaks(tops, forecast, combos)
    kind = F.col("measurement") if "measurement" in combined.columns else "combined"
    stages = {
        "average": (stream_moving_average(readings), "ma", "average"),
        "index": (stream_raw_index(readings, align_minutes=align_minutes), "ri", "index"),
        "peaks": (named(tops), "peak", "peaks"),
        "adjusted": (named(stream_adjusted(readings, profile, pairs)), "adjusted", "adjusted"),
        "combined": (named(combined), "value", kind),
    }
    started = [
        write_stream_points(
            df, f"{path}/{name}", f"{checkpoint}/{name}", measurement, value=value, available_now=available_now
        )
        for name, (df, value, measurement) in stages.items()
    ]
    if rejects is not None:
        started.append(
            write_stream(rejects, f"{path}/rejects", f"{checkpoint}/rejects", available_now=available_now)
        )
    return started
