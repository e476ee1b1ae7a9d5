"""Text and CSV inputs, each with an explicit schema.

Rows that cannot be parsed need not be lost: with ``rejects`` the readers hand them
back as a second DataFrame with the original columns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom import schemas
from meterloom.functions.calendar import dayslot_ts


def parse_dayslot(
    raw: DataFrame, split: bool = False, day_base: int = 1, slot_label: str = "end"
) -> tuple[DataFrame, DataFrame]:
    """Readings and rejects from text columns.

    ``raw`` has ``meter, code, value`` where code is three digits of day and two
    of half-hour slot, or with ``split`` ``meter, day, slot, value``.
    """
    if split:
        day, slot = F.col("day"), F.col("slot")
    else:
        day, slot = F.substring("code", 1, 3), F.substring("code", 4, 2)
    parsed = (
        raw.withColumn("_day", day.try_cast("int"))
        .withColumn("_slot", slot.try_cast("int"))
        .withColumn("_value", F.col("value").try_cast("double"))
    )
    good = (
        F.col("meter").isNotNull()
        & F.col("_day").isNotNull()
        & F.col("_slot").isNotNull()
        & F.col("_value").isNotNull()
    )
    readings = parsed.where(good).select(
        F.col("meter").alias("key"),
        dayslot_ts(F.col("_day"), F.col("_slot"), day_base, slot_label).alias("ts"),
        F.col("_value").alias("value"),
    )
    return readings, parsed.where(~good).select(*raw.columns)


def read_dayslot(
    spark: SparkSession,
    path: str | list[str],
    split: bool = False,
    header: bool = False,
    day_base: int = 1,
    slot_label: str = "end",
    rejects: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Half-hourly readings from CSV files, one or many meters per file."""
    schema = schemas.DAYSLOT_SPLIT_TEXT if split else schemas.DAYSLOT_TEXT
    raw = spark.read.csv(path, schema=schema, header=header, enforceSchema=True)
    readings, bad = parse_dayslot(raw, split, day_base, slot_label)
    return (readings, bad) if rejects else readings


def parse_weather(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weather readings and rejects from the text columns ``meter_id, date, hour, reading, temperature``.

    A reject lacks a field, or has one that is no whole number, ``yyyy-MM-dd`` date, hour
    of 0 to 23, or number; it keeps its text.
    """
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date").try_cast("date"))
    hour = F.col("hour").try_cast("int")
    cells = {
        "meter_id": F.col("meter_id").try_cast("int"),
        "date": day,
        "hour": F.when(hour.between(0, 23), hour),
        "reading": F.col("reading").try_cast("double"),
        "temperature": F.col("temperature").try_cast("double"),
    }
    parsed = raw.withColumn("_cells", F.struct(*[cell.alias(name) for name, cell in cells.items()]))
    good = reduce(and_, [F.col(f"_cells.{name}").isNotNull() for name in cells])
    return parsed.where(good).select("_cells.*"), parsed.where(~good).select(*raw.columns)


def read_weather(
    spark: SparkSession, path: str | list[str], header: bool = False, rejects: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Hourly readings with temperature: ``meter,date,hour,reading,temperature``.

    A bad line ends the job, or with ``rejects`` lands in the second DataFrame (`parse_weather`).
    """
    if rejects:
        return parse_weather(spark.read.csv(path, schema=schemas.WEATHER_TEXT, header=header))
    return spark.read.csv(
        path, schema=schemas.WEATHER, header=header, dateFormat="yyyy-MM-dd", mode="FAILFAST"
    )


def parse_activity(lines: DataFrame, rejects: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Profiles from ``meter|24 means|24 standard deviations`` lines in ``value``.

    With ``rejects`` lines of any other form come back in a second DataFrame; without, a
    field that is no number ends the job.
    """
    field = F.split("value", r"\|")
    if rejects:
        numbers = lambda n: F.transform(F.split(F.get(field, n), ","), lambda x: x.try_cast("double"))
        parsed = lines.select(
            "value",
            F.get(field, 0).try_cast("int").alias("meter_id"),
            numbers(1).alias("mean"),
            numbers(2).alias("std"),
            F.size(field).alias("_fields"),
        )
        whole = lambda c: (F.size(c) == 24) & F.forall(c, lambda x: x.isNotNull())
        good = (F.col("_fields") == 3) & F.col("meter_id").isNotNull() & whole("mean") & whole("std")
        good = F.coalesce(good, F.lit(False))
        return parsed.where(good).select("meter_id", "mean", "std"), parsed.where(~good).select("value")
    numbers = lambda n: F.split(field[n], ",").cast("array<double>")
    return lines.select(
        field[0].cast("int").alias("meter_id"),
        numbers(1).alias("mean"),
        numbers(2).alias("std"),
    )


def read_activity(
    spark: SparkSession, path: str, rejects: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    return parse_activity(spark.read.text(path), rejects)


def parse_temperature_seed(lines: DataFrame) -> DataFrame:
    """``(i, temp)`` rows from the first of the ``|``-separated lines in ``value``."""
    return lines.limit(1).select(
        F.posexplode(F.split("value", r"\|").cast("array<double>")).alias("i", "temp")
    )


def read_temperature_seed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Temperature seed; only the first line counts, of several files that of the first by path.

    A file's first line is in the piece of it that starts at 0, whose rows keep their order.
    """
    lines = spark.read.text(path).select(
        "value", F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("row")).alias("at"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    first = lines.where("start = 0").agg(F.min_by("value", "at").alias("value"))
    return parse_temperature_seed(first)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text lines in column ``text``, for `wordcount`."""
    return spark.read.text(path).withColumnRenamed("value", "text")
