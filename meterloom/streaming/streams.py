"""Streaming sources and operators.

Event time is the reading's timestamp.  The watermark trails the newest one by a day
by default, because the half hours of a day may arrive in any order; readings
later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterloom import schemas
from meterloom.functions.blocks import duration_us, epoch_us, whole_div
from meterloom.operators.combine import paired_forecast
from meterloom.operators.profile import periodic_index
from meterloom.operators.wordcount import wordcount
from meterloom.sources.readers import parse_dayslot

DELAY = "1 day"


def stream_readings(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.READINGS,
    format: str = "parquet",
    ts: str = "ts",
    delay: str = DELAY,
    **options: str,
) -> DataFrame:
    """Readings from files as they arrive, with event time and watermark."""
    raw = spark.readStream.schema(schema).format(format).options(**options).load(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_dayslot(
    spark: SparkSession,
    path: str,
    split: bool = False,
    header: bool = False,
    day_base: int = 1,
    slot_label: str = "end",
    delay: str = DELAY,
    rejects: bool = False,
    **options: str,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Half-hourly day-slot CSV files as they arrive.

    With ``rejects`` the lines that cannot be parsed come as a second stream, with their
    own columns; give it a sink of its own.
    """
    schema = schemas.DAYSLOT_SPLIT_TEXT if split else schemas.DAYSLOT_TEXT
    reader = spark.readStream.schema(schema).options(**options)
    raw = reader.csv(path, header=header, enforceSchema=True)
    readings, bad = parse_dayslot(raw, split, day_base, slot_label)
    readings = readings.withWatermark("ts", delay)
    return (readings, bad) if rejects else readings


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Text lines from files as they arrive, in column ``text``."""
    return spark.readStream.options(**options).text(path).withColumnRenamed("value", "text")


def stream_time_grid(
    spark: SparkSession, start: datetime, period: str | timedelta = "1 second", rows: int = 10
) -> DataFrame:
    """An endless grid of points with value 0, ``rows`` per micro-batch."""
    step = duration_us(period)
    origin = F.lit(start.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).load()
    return ticks.select(
        F.timestamp_micros(F.unix_micros(origin) + F.col("value") * step).alias("ts"),
        F.lit(0.0).alias("value"),
    )


def _windowed(readings: DataFrame, ts: str, value: str, window: str, slide: str, points: int | None) -> DataFrame:
    need = duration_us(window) // duration_us(slide) if points is None else points
    return (
        readings.groupBy("key", F.window(ts, window, slide).alias("window"))
        .agg(F.avg(value).alias("ma"), F.count(value).alias("_n"), F.min(ts).alias("_first"))
        .where(F.col("_n") >= need)
    )


def stream_moving_average(
    readings: DataFrame,
    ts: str = "ts",
    value: str = "value",
    window: str = "120 minutes",
    slide: str = "30 minutes",
    points: int | None = None,
) -> DataFrame:
    """`moving_average` of a stream, emitted once a window has closed."""
    rows = _windowed(readings, ts, value, window, slide, points)
    return rows.select("key", F.col("_first").alias("ts"), "ma")


def stream_raw_index(
    readings: DataFrame,
    ts: str = "ts",
    value: str = "value",
    window: str = "120 minutes",
    slide: str = "30 minutes",
    points: int | None = None,
    align_minutes: int | None = None,
) -> DataFrame:
    """`raw_index` of a stream: readings joined with closed windows on key and start.

    ``align_minutes=120`` keeps only readings on 2-hour boundaries; the others enter the
    averages but not the state of the join.

    A window closes only when the watermark has passed its end, so readings must
    stay in the join state for as long as a window lasts: the time range in the condition
    says so, and also lets older ones go.
    """
    averages = _windowed(readings, ts, value, window, slide, points).select(
        F.col("key").alias("_key"),
        F.unix_micros("window.start").alias("_start"),
        F.window_time("window").alias("_closed"),
        "ma",
    )
    length = F.expr(f"INTERVAL {duration_us(window) // 1_000_000} SECONDS")
    if align_minutes is not None:
        readings = readings.where(F.pmod(epoch_us(ts), F.lit(align_minutes * 60_000_000)) == 0)
    joined = readings.join(
        averages,
        (F.col("key") == F.col("_key"))
        & (epoch_us(ts) == F.col("_start"))
        & (F.col(ts) >= F.col("_closed") - length)
        & (F.col(ts) <= F.col("_closed")),
    )
    index = F.when(F.col("ma") != 0, F.col(value) / F.col("ma")).otherwise(F.col(value))
    return joined.select("key", F.col(ts).alias("ts"), index.alias("ri"))


def stream_count_trigger(
    readings: DataFrame,
    ts: str = "ts",
    value: str = "value",
    window: str = "120 minutes",
    slide: str = "30 minutes",
    points: int = 4,
) -> DataFrame:
    """Moving average with early results: a window emits at every ``points``-th reading.

    The mean is over all its readings so far, stamped with the earliest of them; those
    without a value do not count.  State per window is a count, a sum and a time; a timer
    after the last window of a day clears that day's.
    """
    span, step = duration_us(window), duration_us(slide)
    t = epoch_us(ts)
    last = t - F.pmod(t, F.lit(step))
    # The rows reach the processor as named tuples, whose names begin with a letter.
    exploded = readings.where(F.col(value).isNotNull()).select(
        "key",
        ts,
        F.col(value).cast("double").alias("x"),
        F.explode(F.sequence(last - (span - step), last, F.lit(step))).alias("start"),
    ).withColumns({"us": epoch_us(ts), "block": whole_div(F.col("start"), _STATE_SPAN)})
    emitted = exploded.groupBy("key", "block").transformWithStateInPandas(
        _WindowMeans(span, points), "key string, us long, ma double", "Append", "EventTime"
    )
    return emitted.select("key", F.timestamp_micros("us").alias("ts"), "ma")


#: Windows that start within so many microseconds share one state and one timer.
_STATE_SPAN = duration_us("1 day")


class _WindowMeans(StatefulProcessor):
    """Count, sum and earliest time of each window of a day; a row at every ``points``-th reading."""

    def __init__(self, span: int, points: int) -> None:
        self._span, self._points = span, points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._sums = handle.getValueState(
            "sums", "start array<long>, n array<long>, total array<double>, first array<long>"
        )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [chunk for chunk in rows if len(chunk)]
        if not chunks:
            return
        known = self._sums.get()
        if not known:
            end = int((key[1] + 1) * _STATE_SPAN + self._span) // 1000
            self._handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        sums = {int(s): (n, total, first) for s, n, total, first in zip(*known)} if known else {}
        out = []
        for start, window in pd.concat(chunks).sort_values("us").groupby("start"):
            earliest = int(window["us"].iloc[0])
            count, total, first = sums.get(int(start), (0, 0.0, earliest))
            first = min(int(first), earliest)
            counts = count + np.arange(1, len(window) + 1)
            totals = total + window["x"].to_numpy().cumsum()
            sums[int(start)] = (int(counts[-1]), float(totals[-1]), first)
            full = counts % self._points == 0
            out.append(pd.DataFrame({"key": key[0], "us": first, "ma": totals[full] / counts[full]}))
        starts = sorted(sums)
        self._sums.update((starts, *[[sums[s][k] for s in starts] for k in range(3)]))
        yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._sums.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_periodic_index(index: DataFrame, ts: str = "ts", value: str = "ri") -> DataFrame:
    """Running profile of a stream; 168 cells of state per key (update or complete mode)."""
    return periodic_index(index, "mean", ts, value)


def _with_static_profile(
    readings: DataFrame, profile: DataFrame, pairs: DataFrame | None, ts: str
) -> tuple[DataFrame, list[str]]:
    """Readings with ``pi`` of their hour, and the columns that name the series."""
    cells = profile.select("key", F.col("dow").alias("_dow"), F.col("hour").alias("_hour"), "pi")
    names = ["key"]
    if pairs is not None:
        cells = pairs.select("key", "profile_key").distinct().join(
            cells.withColumnRenamed("key", "profile_key"), "profile_key"
        )
        names = ["key", "profile_key"]
    tagged = readings.withColumns({"_dow": F.dayofweek(ts), "_hour": F.hour(ts)})
    return tagged.join(cells, ["key", "_dow", "_hour"]), names


def stream_peaks(
    readings: DataFrame,
    profile: DataFrame,
    pairs: DataFrame | None = None,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """`peaks` of a stream against a trained profile.

    ``pairs(key, profile_key)`` lists which profiles a key is set against; with it the
    result has ``profile_key``.
    """
    cells = profile.where(F.col("pi").isNotNull())
    joined, names = _with_static_profile(readings, cells, pairs, ts)
    return joined.select(
        *names, F.col(ts).alias("ts"), F.dayofweek(ts).alias("dow"), (F.col(value) - F.col("pi")).alias("peak")
    )


def stream_adjusted(
    readings: DataFrame,
    profile: DataFrame,
    pairs: DataFrame | None = None,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """`adjusted_series` of a stream against a trained profile; ``pairs`` as in `stream_peaks`."""
    joined, names = _with_static_profile(readings, profile.where(F.col("pi") != 0), pairs, ts)
    return joined.select(
        *names,
        F.col(ts).alias("ts"),
        F.dayofweek(ts).alias("dow"),
        (F.col(value) / F.col("pi")).alias("adjusted"),
    )


def stream_add_peaks(
    peaks: DataFrame, forecast: DataFrame, combos: DataFrame | None = None, ts: str = "ts"
) -> DataFrame:
    """`add_peaks` of a stream of peaks against a stored forecast, at equal times.

    Peaks without ``profile_key`` are those by the series' own profile.  A peak that meets
    a null forecast (series too short) gives a null ``value``; forecast steps whose peak has
    not arrived give no row, since it may still come.
    """
    paired, extra = paired_forecast(forecast, combos, ts)
    own = F.col("profile_key") if "profile_key" in peaks.columns else F.col("key")
    arriving = peaks.select(
        F.col("key").alias("p_key"), own.alias("p_profile"), ts, "dow", "peak"
    )
    return arriving.join(paired, ["p_key", "p_profile", ts]).select(
        *extra,
        "f_key",
        "f_profile",
        F.col("p_key").alias("key"),
        F.col("p_profile").alias("profile_key"),
        ts,
        "dow",
        (F.col("yhat") + F.col("peak")).alias("value"),
    )


def stream_join_forecast(
    forecasts: DataFrame, peaks: DataFrame, combos: DataFrame | None = None, ts: str = "ts"
) -> DataFrame:
    """`add_peaks` of two streams: every forecast step once, with the peak of its time or none.

    A step that meets its peak comes out as soon as both have arrived.  One whose peak never
    comes is emitted with a null ``value`` once the watermark, the older one of both streams,
    has passed its time; until then it waits in the state, and so do peaks.  Both streams
    need a watermark on ``ts``.  ``combos`` is a stored table, as in `add_peaks`.
    """
    steps = forecasts.select(
        F.col("key").alias("f_key"), F.col("profile_key").alias("f_profile"), ts, "yhat"
    )
    if combos is None:
        steps = steps.withColumns({"p_key": F.col("f_key"), "p_profile": F.col("f_profile")})
        extra = []
    else:
        steps = steps.join(combos, ["f_key", "f_profile"])
        extra = [c for c in combos.columns if c not in ("f_key", "f_profile", "p_key", "p_profile")]
    own = F.col("profile_key") if "profile_key" in peaks.columns else F.col("key")
    arriving = peaks.select(F.col("key").alias("p_key"), own.alias("p_profile"), ts, "peak")
    # The time is part of the key, so the watermark also bounds the state.
    return steps.join(arriving, ["p_key", "p_profile", ts], "left").select(
        *extra,
        "f_key",
        "f_profile",
        F.col("p_key").alias("key"),
        F.col("p_profile").alias("profile_key"),
        ts,
        F.dayofweek(ts).alias("dow"),
        (F.col("yhat") + F.col("peak")).alias("value"),
    )


def stream_wordcount(lines: DataFrame, text: str = "text") -> DataFrame:
    """Running word counts (update or complete mode)."""
    return wordcount(lines, text)
