"""Regular time grids, and readings completed to such a grid."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.blocks import TIME_BLOCK, duration_us, epoch_us, fan_out, whole_div
from meterloom.functions.calendar import slot_start


def time_grid_range(
    spark: SparkSession, lo: datetime, hi: datetime, period: str | timedelta = "30 minutes"
) -> DataFrame:
    """Grid points ``lo, lo+period, .. <= hi`` with value 0; ``lo`` is floored to a second."""
    step = duration_us(period)
    start = lo.replace(microsecond=0)
    points = (hi - start) // timedelta(microseconds=step) + 1
    origin = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return spark.range(max(points, 0)).select(
        F.timestamp_micros(F.unix_micros(origin) + F.col("id") * step).alias("ts"),
        F.lit(0.0).alias("value"),
    )


def time_grid(
    bounds: DataFrame,
    period: str | timedelta = "30 minutes",
    lo: str = "lo",
    hi: str = "hi",
    block: str | timedelta = TIME_BLOCK,
) -> DataFrame:
    """One row per grid point between ``lo`` and ``hi`` of every row of ``bounds``.

    The other columns of ``bounds`` are kept.  A long range is first cut into
    blocks and these are spread over the cluster, so that one long series is not
    expanded by a single task.
    """
    step = duration_us(period)
    span = max(duration_us(block) // step, 1) * step
    others = [c for c in bounds.columns if c not in (lo, hi)]
    first, last = F.col("_lo"), F.col("_hi")
    blocks = fan_out(
        bounds.select(*others, epoch_us(lo).alias("_lo"), epoch_us(hi).alias("_hi"))
        .where(first <= last)
        .withColumn("_from", F.explode(F.sequence(first, last, F.lit(span)))),
        *others,
        "_from",
    )
    until = F.least(last, F.col("_from") + span - step)
    return blocks.withColumn(
        "_t", F.explode(F.sequence("_from", until, F.lit(step)))
    ).select(*others, F.timestamp_micros("_t").alias("ts"))


def gap_fill(
    readings: DataFrame,
    period: str | timedelta = "30 minutes",
    keys: Sequence[str] = ("key",),
    ts: str = "ts",
    value: str = "value",
    fill: float = 0.0,
    scope: str = "global",
) -> DataFrame:
    """One row per key and slot: the sum of the slot's readings, ``fill`` where none.

    The grid runs from the first to the last slot of all readings
    (``scope='global'``) or of each series (``'series'``).  Only slots with readings are
    summed and shuffled, together with the two ends of each block of the grid; each then
    stands for the empty slots up to the next one, which are added last.  So no join is
    needed, a crowded slot is summed before the shuffle, no task holds the rows it adds,
    and the result has at most one row per key and slot.
    """
    keys = list(keys)
    step = duration_us(period)
    span = max(duration_us(TIME_BLOCK) // step, 1) * step
    slots = readings.select(
        *keys, epoch_us(slot_start(ts, period)).alias("_t"), F.col(value).cast("double").alias("_v")
    )
    spans = slots.groupBy(*keys).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    if scope == "global":
        # The bounds over all keys come from the spans per key, whose scan and shuffle
        # both uses share.
        whole = spans.agg(F.struct(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).alias("b"))
        spans = spans.withColumn("_w", whole.scalar()).select(
            *keys, F.least("_lo", "_w.lo").alias("_lo"), F.greatest("_hi", "_w.hi").alias("_hi")
        )
    elif scope != "series":
        raise ValueError("scope is 'global' or 'series'")
    block, first, last = F.col("_b"), F.col("_lo"), F.col("_hi")
    ends = F.array(F.greatest(first, block * span), F.least(last + step, (block + 1) * span))
    edges = (
        spans.where(first <= last)
        .withColumn("_b", F.explode(F.sequence(whole_div(first, span), whole_div(last, span))))
        .select(*keys, "_b", F.explode(ends).alias("_t"), F.lit(None).cast("double").alias("_v"))
    )
    sums = (
        slots.withColumn("_b", whole_div(F.col("_t"), span))
        .unionByName(edges)
        .groupBy(*keys, "_b", "_t")
        .agg(F.sum("_v").alias("_v"))
    )
    following = F.lead("_t").over(Window.partitionBy(*keys, "_b").orderBy("_t"))
    runs = fan_out(sums, *keys, "_b").withColumn("_next", following)
    # The last row of a block is its end; readings without a time keep a row of their own.
    timeless = F.col("_t").isNull()
    run = F.sequence(F.col("_t"), F.col("_next") - step, F.lit(step))
    alone = F.array(F.lit(None).cast("long"))
    filled = F.when(F.col("_at").eqNullSafe(F.col("_t")), F.col("_v"))
    return (
        runs.where(timeless | F.col("_next").isNotNull())
        .select(*keys, "_t", "_v", F.explode(F.when(timeless, alone).otherwise(run)).alias("_at"))
        .select(
            *keys, F.timestamp_micros("_at").alias(ts), F.coalesce(filled, F.lit(float(fill))).alias(value)
        )
    )
