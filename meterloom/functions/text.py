"""Text forms of points, profiles and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: str | Column) -> Column:
    """Lower-cased runs of word characters."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(r"\w+"), F.lit(0))


def _escaped(tag: Column) -> Column:
    return F.regexp_replace(tag, r"([,= ])", r"\\$1")


def _number(value: str, value_format: str | None) -> Column:
    return F.col(value).cast("string") if value_format is None else F.format_string(value_format, value)


def line_protocol(
    measurement: Column,
    key: str = "key",
    ts: str = "ts",
    value: str = "value",
    value_format: str | None = None,
) -> Column:
    """``measurement,key=K value=V time`` with the time in milliseconds."""
    return F.concat(
        _escaped(measurement),
        F.lit(",key="),
        _escaped(F.col(key)),
        F.lit(" value="),
        _number(value, value_format),
        F.lit(" "),
        F.unix_millis(F.col(ts).cast("timestamp")).cast("string"),
    )


def point_csv(
    ts: str = "ts", key: str = "key", value: str = "value", value_format: str | None = None
) -> Column:
    """``time,key,value`` with the time in milliseconds."""
    return F.concat_ws(
        ",",
        F.unix_millis(F.col(ts).cast("timestamp")).cast("string"),
        F.col(key),
        _number(value, value_format),
    )


def activity_line(meter: str = "meter_id", mean: str = "mean", std: str = "std") -> Column:
    """``meter|24 means|24 standard deviations``."""
    return F.concat_ws(
        "|",
        F.col(meter).cast("string"),
        *[F.array_join(F.col(c).cast("array<string>"), ",") for c in (mean, std)],
    )


def synthetic_line(
    id: str = "id", date: str = "date", hour: str = "hour", load: str = "load", temp: str = "temp"
) -> Column:
    """``id|yyyy-MM-dd H:00:00|load|temperature``, numbers with six decimals."""
    return F.format_string(
        "%d|%s %d:00:00|%.6f|%.6f",
        F.col(id).cast("long"),
        F.date_format(date, "yyyy-MM-dd"),
        F.col(hour),
        F.col(load),
        F.col(temp),
    )
