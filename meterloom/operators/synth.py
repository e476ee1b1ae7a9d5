"""Synthetic meter series from activity profiles and a temperature seed.

Noise is drawn from hashes of (seed, series, hour), so a retried or differently
partitioned task produces the same rows.  The hash uses whole numbers below 2^60 only,
so any SQL engine repeats it; ids are whole numbers.  ``sigma=0`` and fixed breakpoints
make a deterministic mode.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.blocks import fan_out, pack, spread_join, whole_div
from meterloom.operators.thermal import date_block

# Slopes of the three sections, load limits, noise of the temperature
# and of the activity, scale of the base load, ranges of the two breakpoints.
SLOPES = (-0.0059, 0.0155, 0.2233)
LOAD_RANGE = (0.0, 0.2)
TEMPERATURE_STD = 2.0
ACTIVITY_STD = 0.1
BASE_SCALE = 1.5
FIRST_BREAK = (10, 6)
SECOND_GAP = (4, 9)

_METERS_PER_BLOCK = 10_000
_IDS_PER_SALT = 100_000
_LOW = (1 << 32) - 1
_CELLS_PER_STEP = 1 << 18
_DAY_FIELDS = [
    T.StructField("day", T.IntegerType()),
    T.StructField("_mean", T.DoubleType()),
    T.StructField("loads", T.ArrayType(T.DoubleType())),
    T.StructField("temps", T.ArrayType(T.DoubleType())),
]


def draw(seed: int, purpose: str, *what: Column | str) -> Column:
    """Whole number in 0..2^32-1 from the seed, the purpose and whole-number arguments.

    Each 32-bit half of an argument is mixed in by two rounds of ``h = (h xor v)``,
    ``h = (h xor h >> 16) * 73244475 mod 2^32``, the second with v = 0.
    """
    whole = [F.col(c) if isinstance(c, str) else c for c in what]
    halves = [F.lit(crc32(purpose.encode())).cast("long")]
    for value in whole:
        value = value.cast("long")
        halves += [value.bitwiseAND(F.lit(_LOW)), F.shiftright(value, 32).bitwiseAND(F.lit(_LOW))]
    zero = F.lit(0).cast("long")
    steps = F.array(*[x for half in halves for x in (half, zero)], zero)

    def mixed(h: Column, v: Column) -> Column:
        y = h.bitwiseXOR(v)
        return (F.shiftright(y, 16).bitwiseXOR(y) * F.lit(73244475)).bitwiseAND(F.lit(_LOW))

    return F.aggregate(steps, F.lit(seed & _LOW).cast("long"), mixed)


def with_draw(df: DataFrame, names: dict[str, str], seed: int, *what: Column | str) -> DataFrame:
    """Rows with a `draw` for each ``name: purpose``, from the same arguments.

    Every round is a column of its own, which Spark compiles; `draw` folds over an array, which
    it does not.  For many rows this takes a small part of the time.
    """
    states = {}
    for name, purpose in names.items():
        h = seed & _LOW
        for v in (crc32(purpose.encode()), 0):
            y = h ^ v
            h = (((y >> 16) ^ y) * 73244475) & _LOW
        states[name] = F.lit(h).cast("long")
    halves = []
    for value in [F.col(c) if isinstance(c, str) else c for c in what]:
        value = value.cast("long")
        halves += [value.bitwiseAND(F.lit(_LOW)), F.shiftright(value, 32).bitwiseAND(F.lit(_LOW))]
    zero = F.lit(0).cast("long")
    for v in [*[x for half in halves for x in (half, zero)], zero]:
        df = df.withColumns({f"_{name}": h.bitwiseXOR(v) for name, h in states.items()})
        for name in names:
            y = F.col(f"_{name}")
            states[name] = (F.shiftright(y, 16).bitwiseXOR(y) * F.lit(73244475)).bitwiseAND(F.lit(_LOW))
    return df.withColumns(states).drop(*[f"_{name}" for name in names])


def with_gaussian(df: DataFrame, names: dict[str, str], seed: int, *what: Column | str) -> DataFrame:
    """Rows with a `gaussian` for each ``name: purpose``, from the same arguments; see `with_draw`."""
    parts = {f"{n}{side}": f"{p} {side}" for n, p in names.items() for side in ("radius", "angle")}
    drawn = with_draw(df, parts, seed, *what)
    unit = lambda c: (F.col(c).cast("double") + 0.5) / float(1 << 32)
    normal = lambda n: F.sqrt(-2.0 * F.log(unit(f"{n}radius"))) * F.cos(2.0 * math.pi * unit(f"{n}angle"))
    return drawn.withColumns({n: normal(n) for n in names}).drop(*parts)


def uniform(seed: int, purpose: str, *what: Column | str) -> Column:
    """Uniform in (0, 1), a function of seed, purpose and arguments only."""
    return (draw(seed, purpose, *what).cast("double") + 0.5) / float(1 << 32)


def gaussian(seed: int, purpose: str, *what: Column | str) -> Column:
    """Standard normal draw (Box-Muller), a function of seed, purpose and arguments only."""
    u = uniform(seed, purpose + " radius", *what)
    v = uniform(seed, purpose + " angle", *what)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def _integer(seed: int, low: int, count: int, purpose: str, *what: Column | str) -> Column:
    return F.lit(low) + F.floor(uniform(seed, purpose, *what) * count).cast("int")


def synth_ids(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Ids 0..n-1, none cut off when ``n`` is no multiple of the partitions."""
    return spark.range(0, n, 1, partitions)


def number_profiles(activity: DataFrame, meter: str = "meter_id") -> DataFrame:
    """Add ``number`` 0..n-1 in meter order and the count ``n``, without one global sort."""
    bucket = whole_div(F.col(meter), _METERS_PER_BLOCK)
    return pack(activity, [], [meter], bucket).rows().withColumnRenamed("i", "number").drop("_b")


def synth_assign(
    ids: DataFrame, activity: DataFrame, seed: int = 0, mode: str = "random", meter: str = "meter_id"
) -> DataFrame:
    """Give every id a seed profile: ``(id, meter, mean)``.

    ``random`` hashes the id, ``cyclic`` takes profile ``id mod n``.  Ids are spread
    evenly over the profiles; where there are many for each, a profile is copied so often
    that a copy meets about 100 000 ids.
    """
    numbered = number_profiles(activity, meter).select("number", meter, "mean")
    count = max(1, activity.count())
    drawn = draw(seed, "profile", "id") if mode == "random" else F.col("id").cast("long")
    salts = max(1, ids.count() // (_IDS_PER_SALT * count))
    salted = numbered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        ids.select("id", F.pmod(drawn, F.lit(count)).alias("number"))
        .withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        .join(salted, ["number", "_salt"])
        .drop("number", "_salt")
    )


def synth_grid(
    ids: DataFrame, start_date: str, days: int, partitions: int | None = None
) -> DataFrame:
    """Every id with every hour: adds ``day`` (0-based), ``date``, ``hour`` and ``i``.

    Ids are spread over ``partitions`` tasks (default: the shuffle partitions) first.
    """
    return (
        fan_out(ids, "id", partitions=partitions)
        .withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
        .withColumn("date", F.date_add(F.lit(start_date).cast("date"), F.col("day")))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .withColumn("i", F.col("day") * 24 + F.col("hour"))
    )


def synth_temperature(
    grid: DataFrame, seed_temperature: DataFrame, sigma: float = TEMPERATURE_STD, seed: int = 0
) -> DataFrame:
    """Add ``temp``: the seed at ``i mod length`` plus noise of ``sigma``.

    The seed ``(i, temp)`` is one line of a file; Spark broadcasts it by its size.
    """
    length = seed_temperature.agg(F.count(F.lit(1))).scalar()
    base = seed_temperature.select(F.col("i").alias("_at"), F.col("temp").alias("_base"))
    joined = grid.withColumn("_at", F.pmod(F.col("i").cast("long"), length).cast("int")).join(
        base.withColumn("_at", F.col("_at").cast("int")), "_at"
    )
    noise = F.lit(0.0)
    if sigma:
        joined, noise = with_gaussian(joined, {"_noise": "temperature"}, seed, "id", "i"), F.col("_noise") * sigma
    return joined.withColumn("temp", F.col("_base") + noise).drop("_at", "_base", "_noise")


def load_curve(temp: Column, lowest: Column, base: Column, x1: Column, x2: Column) -> Column:
    """Piecewise linear load over temperature, clamped to the load range."""
    a, b, c = SLOPES
    knee = a * (x1 - lowest) + base
    load = (
        F.when(temp < x1, a * (temp - lowest) + base)
        .when(temp < x2, b * (temp - x1) + knee)
        .otherwise(c * (temp - x2) + b * (x2 - x1) + knee)
    )
    low, high = LOAD_RANGE
    return F.least(F.greatest(load, F.lit(low)), F.lit(high))


def _curve_parameters(
    id: Column, seed: int, x1: int | None, x2: int | None, y0: float | None
) -> tuple[Column, Column, Column]:
    first = F.lit(x1) if x1 is not None else _integer(seed, *FIRST_BREAK, "first break", id)
    second = F.lit(x2) if x2 is not None else first + _integer(seed, *SECOND_GAP, "second break", id)
    base = (
        F.lit(float(y0)) if y0 is not None else F.abs(gaussian(seed, "base load", id) / BASE_SCALE)
    )
    return base, first, second


def thermal_load(
    series: DataFrame,
    id: str = "id",
    temp: str = "temp",
    seed: int = 0,
    x1: int | None = None,
    x2: int | None = None,
    y0: float | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Add ``thermal``, the load due to temperature.

    The curve starts at the lowest temperature of the series; base load and
    breakpoints are drawn per series unless given.  ``block`` splits a long
    series for the join with its minimum (default: by ``date``).
    """
    lowest = series.groupBy(id).agg(F.min(temp).alias("_x0"))
    joined = spread_join(series, lowest, [id], date_block() if block is None else block)
    base, first, second = _curve_parameters(F.col(id), seed, x1, x2, y0)
    return joined.withColumn(
        "thermal", load_curve(F.col(temp), F.col("_x0"), base, first, second)
    ).drop("_x0")


def synth_activity(
    series: DataFrame, mean: str = "mean", sigma: float = ACTIVITY_STD, seed: int = 0
) -> DataFrame:
    """Add ``activity``: the profile mean of the hour plus noise, not below zero."""
    noise = F.lit(0.0)
    if sigma:
        series, noise = with_gaussian(series, {"_noise": "activity"}, seed, "id", "i"), F.col("_noise") * sigma
    return series.withColumn(
        "activity", F.greatest(F.get(F.col(mean), F.col("hour")) + noise, F.lit(0.0))
    ).drop("_noise")


def amplified(load: Column, mean: Column, ratio: float) -> Column:
    """What exceeds the daily mean, scaled by ``ratio``."""
    return F.when(load > mean, mean + (load - mean) * ratio).otherwise(load)


def peak_amplify(
    series: DataFrame,
    ratio: float,
    keys: tuple[str, ...] = ("id", "date"),
    value: str = "load",
    out: str = "load",
) -> DataFrame:
    """Amplify readings above the mean of their series and day."""
    day = Window.partitionBy(*keys)
    return (
        series.withColumn("_mean", F.avg(value).over(day))
        .withColumn(out, amplified(F.col(value), F.col("_mean"), ratio))
        .drop("_mean")
    )


def _normal_table(seed: int, purpose: str, ids: np.ndarray, hours: np.ndarray) -> np.ndarray:
    """`gaussian` of seed, purpose, id and hour for every id (rows) and hour (columns)."""
    mask, factor, shift = np.uint64(_LOW), np.uint64(73244475), np.uint64(16)
    halves = lambda x: (x & mask, (x >> np.uint64(32)) & mask)
    rows, columns = ids.astype(np.uint64)[:, None], hours.astype(np.uint64)[None, :]

    def even(side: str) -> np.ndarray:
        h, zero = np.uint64(seed & _LOW), np.uint64(0)
        for half in (np.uint64(crc32(f"{purpose} {side}".encode())), *halves(rows), *halves(columns)):
            for v in (half, zero):
                y = h ^ v
                h = (((y >> shift) ^ y) * factor) & mask
        h = (((h >> shift) ^ h) * factor) & mask
        return (h.astype(float) + 0.5) / float(1 << 32)

    return np.sqrt(-2.0 * np.log(even("radius"))) * np.cos(2.0 * math.pi * even("angle"))


def _numbers(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ``width`` numbers as a table, and which of them are there."""
    flat = lists.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width), there.reshape(-1, width)


def _day_rows(batch: pa.RecordBatch, days: int, seed: int, noise: dict[str, float]) -> pa.RecordBatch:
    """A row per series and day: the day's mean load, 24 loads and 24 temperatures.

    As in the single operators, an hour without a profile mean has no activity, and one
    without a temperature the lowest thermal load.
    """
    n, count, (low, high), (a, b, c) = batch.num_rows, days * 24, LOAD_RANGE, SLOPES
    number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)[:, None]
    ids, hours = number("_id")[:, 0], np.arange(count)
    temps, known = _numbers(batch.column("_seed"), count)
    activity, given = (np.tile(x, (1, days)) for x in _numbers(batch.column("_profile"), 24))
    if noise["temperature"]:
        temps = temps + _normal_table(seed, "temperature", ids, hours) * noise["temperature"]
    if noise["activity"]:
        activity = activity + _normal_table(seed, "activity", ids, hours) * noise["activity"]
    # fmin passes over NaN, as the minimum in SQL does, where NaN is the largest number.
    lowest = np.fmin.reduce(temps, axis=1)[:, None]
    x1, x2, base = number("_x1"), number("_x2"), number("_y0")
    knee = a * (x1 - lowest) + base
    warm = np.where(
        temps < x1,
        a * (temps - lowest) + base,
        np.where(temps < x2, b * (temps - x1) + knee, c * (temps - x2) + b * (x2 - x1) + knee),
    )
    warm = np.where(known, np.fmin(np.maximum(warm, low), high), low)
    loads = np.where(given, np.maximum(activity, 0.0), 0.0) + warm
    total = np.zeros((n, days))
    for h in range(24):
        total = total + loads[:, h::24]
    day_lists = pa.array(np.arange(n * days + 1, dtype=np.int32) * 24)
    lists = lambda x, mask=None: pa.ListArray.from_arrays(day_lists, pa.array(x.ravel(), mask=mask))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id").take(pa.array(np.repeat(np.arange(n), days))),
            pa.array(np.tile(np.arange(days, dtype=np.int32), n)),
            pa.array((total / 24).ravel()),
            lists(loads),
            lists(temps, None if known.all() else ~known.ravel()),
        ],
        names=["id", *[f.name for f in _DAY_FIELDS]],
    )


def synth_readings(
    ids: DataFrame,
    activity: DataFrame,
    seed_temperature: DataFrame,
    start_date: str,
    days: int,
    peaky_ratio: float,
    seed: int = 0,
    assign: str = "random",
    temperature_sigma: float = TEMPERATURE_STD,
    activity_sigma: float = ACTIVITY_STD,
    x1: int | None = None,
    x2: int | None = None,
    y0: float | None = None,
    meter: str = "meter_id",
    partitions: int | None = None,
) -> DataFrame:
    """Synthetic series: ``(id, date, hour, load, temp)``, one row per id and hour.

    After ids have met their profiles, everything about a series follows from its
    own row, so minimum and daily means need no shuffle of the generated rows: tasks make
    the hours of some series at a time as one table of numbers, a row per day.
    """
    hours = F.sequence(F.lit(0), F.lit(days * 24 - 1))
    line = seed_temperature.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("i", "temp"))), lambda s: s["temp"].cast("double")
        ).alias("seed")
    )
    repeated = line.select(F.transform(hours, lambda i: F.get("seed", F.pmod(i, F.size("seed"))))).scalar()
    base, first, second = _curve_parameters(F.col("id"), seed, x1, x2, y0)
    profile = F.array(*[F.get("mean", F.lit(h)).cast("double") for h in range(24)])
    series = fan_out(synth_assign(ids, activity, seed, assign, meter), "id", partitions=partitions).select(
        "id",
        F.col("id").cast("long").alias("_id"),
        profile.alias("_profile"),
        repeated.alias("_seed"),
        base.alias("_y0"),
        first.cast("double").alias("_x1"),
        second.cast("double").alias("_x2"),
    )
    noise = {"temperature": temperature_sigma, "activity": activity_sigma}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, _CELLS_PER_STEP // (days * 24))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield _day_rows(batch.slice(at, size), days, seed, noise)

    schema = T.StructType([T.StructField("id", ids.schema["id"].dataType), *_DAY_FIELDS])
    wide = series.mapInArrow(make, schema)
    return wide.select(
        "id",
        F.date_add(F.lit(start_date).cast("date"), F.col("day")).alias("date"),
        "_mean",
        F.posexplode(F.arrays_zip("loads", "temps")).alias("hour", "h"),
    ).select(
        "id",
        "date",
        "hour",
        amplified(F.col("h.loads"), F.col("_mean"), peaky_ratio).alias("load"),
        F.col("h.temps").alias("temp"),
    )
