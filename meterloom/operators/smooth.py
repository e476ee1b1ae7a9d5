"""Moving averages and the raw index (reading over moving average).

Input has one row per key and slot (see `gap_fill`, `dedupe`).  All frames are
bounded, so windows run over key and time block with a few copied edge rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.functions.blocks import (
    TIME_BLOCK,
    duration_us,
    epoch_us,
    pack,
    time_block,
    with_halo,
)
from meterloom.functions.calendar import slot_number


def _forward_average(
    readings: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    window: str | timedelta,
    slide: str | timedelta,
    points: int | None,
    block: str | timedelta,
) -> DataFrame:
    steps = duration_us(window) // duration_us(slide)
    need = steps if points is None else points
    per_block = max(duration_us(block) // duration_us(slide), steps)
    haloed = with_halo(
        readings.withColumn("_slot", slot_number(ts, slide)), "_slot", per_block, after=steps - 1
    )
    frame = (
        Window.partitionBy(*keys, "_blk").orderBy("_slot").rangeBetween(0, steps - 1)
    )
    return (
        haloed.withColumn("ma", F.avg(value).over(frame))
        .withColumn("_n", F.count(value).over(frame))
        .where(F.col("_own") & (F.col("_n") >= need))
        .drop("_slot", "_blk", "_own", "_n")
    )


def moving_average(
    readings: DataFrame,
    window: str | timedelta = "120 minutes",
    slide: str | timedelta = "30 minutes",
    points: int | None = None,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Mean of the readings in ``[ts, ts + window)``, stamped with the first one.

    Windows with fewer than ``points`` readings (default: one per slide) give no row.
    """
    out = _forward_average(readings, keys, ts, value, window, slide, points, block)
    return out.select(*keys, ts, "ma")


def centered_ma(
    readings: DataFrame,
    half: int = 12,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Centred moving average over ``2 * half`` readings.

    The mean of two means, one over positions ``-half .. half-1`` and one over
    ``-half+1 .. half``, so both outermost readings count half.  The first ``half`` and last ``half`` readings keep their value.
    """
    blocks = pack(readings, keys, [ts], time_block(ts, block))
    rows = blocks.window()
    between = F.sum(value).over(rows.rowsBetween(-half + 1, half - 1))
    ends = F.lag(value, half).over(rows) + F.lead(value, half).over(rows)
    inner = (F.col("i") >= half) & (F.col("i") < F.col("n") - half)
    return (
        blocks.rows(half, half)
        .withColumns({"_between": between, "_ends": ends})
        .where("_own")
        .withColumn(
            "cma",
            F.when(inner, (F.col("_between") + F.col("_ends") * 0.5) / (2 * half)).otherwise(
                F.col(value)
            ),
        )
        .select(*readings.columns, "cma")
    )


def raw_index(
    readings: DataFrame,
    method: str = "forward",
    align_minutes: int | None = None,
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    window: str | timedelta = "120 minutes",
    slide: str | timedelta = "30 minutes",
    points: int | None = None,
    half: int = 12,
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """Reading divided by its moving average.

    ``forward``: over `moving_average`, a zero average passes the reading through;
    readings without a full window have no index.  ``centered``: over
    `centered_ma`; a zero average gives null.  ``align_minutes=120`` keeps only
    readings on 2-hour boundaries.  The average comes from the same window pass,
    so no join is needed.
    """
    if method == "forward":
        both = _forward_average(readings, keys, ts, value, window, slide, points, block)
        index = F.when(F.col("ma") != 0, F.col(value) / F.col("ma")).otherwise(F.col(value))
    elif method == "centered":
        both = centered_ma(readings, half, keys, ts, value, block)
        index = F.try_divide(F.col(value), F.col("cma"))
    else:
        raise ValueError("method is 'forward' or 'centered'")
    if align_minutes is not None:
        both = both.where(F.pmod(epoch_us(ts), F.lit(align_minutes * 60_000_000)) == 0)
    return both.select(*keys, ts, index.alias("ri"))
