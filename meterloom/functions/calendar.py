"""Calendar expressions over a timestamp column.

Weekdays are numbers, 1 = Sunday .. 7 = Saturday, never locale names.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterloom.functions.blocks import duration_us, epoch_us, whole_div

# Fixed value: day codes count from the first day of this year.
DAYSLOT_ORIGIN = "2009-01-01"


def dow(ts: str = "ts") -> Column:
    return F.dayofweek(ts)


def hour_of_week(ts: str = "ts") -> Column:
    """0..167, Sunday 00:00 first."""
    return (F.dayofweek(ts) - 1) * 24 + F.hour(ts)


def slot_start(ts: str | Column, period: str | timedelta) -> Column:
    """Start of the epoch-aligned slot of width ``period``, in the type of a timestamp."""
    us = F.lit(duration_us(period))
    t = epoch_us(ts)
    return F.timestamp_micros(t - F.pmod(t, us))


def slot_number(ts: str, period: str | timedelta) -> Column:
    """Index of that slot since the epoch."""
    return whole_div(epoch_us(ts), duration_us(period))


def day_number(ts: str = "ts", origin: str = DAYSLOT_ORIGIN, day_base: int = 1) -> Column:
    """Day code of a timestamp or date; the origin itself has number ``day_base``."""
    return F.datediff(F.to_date(ts), F.lit(origin).cast("date")) + F.lit(day_base)


def dayslot_ts(
    day: Column, slot: Column, day_base: int = 1, slot_label: str = "end", minutes: int = 30
) -> Column:
    """Timestamp of a (day, slot) code.

    ``day_base`` is the code of the origin day (0 or 1).  ``slot_label='end'``
    stamps slot s at the end of its half hour, so slot 48 falls on the next day;
    ``'pair'`` stamps its start, so slots 1 and 2 share hour 0.
    """
    if slot_label not in ("end", "pair"):
        raise ValueError("slot_label is 'end' or 'pair'")
    steps = slot if slot_label == "end" else slot - 1
    origin = F.lit(DAYSLOT_ORIGIN).cast("timestamp")
    return origin + F.make_dt_interval(days=day - F.lit(day_base), mins=steps * minutes)
