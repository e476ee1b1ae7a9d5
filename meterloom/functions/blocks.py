"""Bounded units of work for series of any length.

A series (one meter) may hold a large share of all rows, so nothing here puts a
whole series into one task.  Rows are tagged with a *block* (a span of time, or a
run of positions) and every shuffle is on ``keys + block``.  What crosses a block
edge travels either as a few copied edge rows (`with_halo`) or as one small row per
block (`pack`, `running_total`, `spread_join`).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TIME_BLOCK = "28 days"
ROW_BLOCK = 4096

_UNIT_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def duration_us(span: str | timedelta) -> int:
    """Microseconds in ``"30 minutes"``, ``"1 day"`` or a timedelta."""
    if isinstance(span, timedelta):
        return span // timedelta(microseconds=1)
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", span.lower())
    if not match or match.group(2) not in _UNIT_US:
        raise ValueError(f"not a duration: {span!r}")
    return int(match.group(1)) * _UNIT_US[match.group(2)]


def epoch_us(ts: str | Column) -> Column:
    """Timestamp as microseconds since the epoch (the session zone is UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def whole_div(value: Column, width: int) -> Column:
    """Integer quotient rounded down, also for negative values."""
    value = value.cast("long")
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def time_block(ts: str | Column = "ts", width: str | timedelta = TIME_BLOCK) -> Column:
    """Number of the time block a row falls into."""
    return whole_div(epoch_us(ts), duration_us(width))


def row_block(position: str = "i", width: int = ROW_BLOCK) -> Column:
    """Number of the block of ``width`` consecutive positions a row falls into."""
    return whole_div(F.col(position), width)


def with_halo(
    df: DataFrame, position: str, width: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Tag rows with ``_blk`` and copy edge rows into the neighbouring block.

    A window over ``keys + _blk`` then sees every row at most ``before`` behind
    and ``after`` ahead.  Keep only rows with ``_own`` afterwards: the copies serve
    the neighbour's frames and would otherwise appear twice.
    """
    if before > width or after > width:
        raise ValueError("the halo must not be wider than a block")
    pos = F.col(position)
    offset = F.pmod(pos, F.lit(width))
    own = whole_div(pos, width)
    # Conditions and not a filter over an array: these are compiled.
    above = F.array(own, own + 1)
    below = F.array(own, own - 1)
    homes = F.array(own)
    if before:
        homes = F.when(offset >= width - before, above).otherwise(homes)
    if after:
        homes = F.when(offset < after, below).otherwise(homes)
    if before and after:
        homes = F.when((offset < after) & (offset >= width - before), F.array(own, own + 1, own - 1)).otherwise(homes)
    return df.withColumn("_blk", F.explode(F.when(pos.isNotNull(), homes))).withColumn(
        "_own", F.col("_blk") == own
    )


class Blocks(NamedTuple):
    """A set of series cut into blocks, each packed into one row.

    ``packed`` has one row per series and block, with the block's readings in order.
    ``offsets`` has one small row per block: what lies before it and the totals of
    its series.  Everything derived from a `Blocks` reads the one shuffle behind
    ``packed``.
    """

    keys: list[str]
    columns: list[str]
    packed: DataFrame
    offsets: DataFrame

    def rows(
        self,
        back: int = 0,
        ahead: int = 0,
        extra: DataFrame | None = None,
        how: str = "inner",
    ) -> DataFrame:
        """Readings with position ``i`` (0-based), length ``n``, the totals and ``_b``.

        With ``back`` or ``ahead`` each block also holds copies of that many readings
        before and after it; windows over `window` then see across its edges, and
        rows that are not ``_own`` must be filtered out afterwards.  ``extra`` is a
        table per series whose columns are attached; it is joined to the offsets
        first and so reaches the readings per block.
        """
        beside = self.offsets
        if extra is not None:
            beside = beside.join(extra, self.keys, how)
        if back or ahead:
            beside = beside.join(self._edges(back, ahead), [*self.keys, "_b"])
        joined = self.packed.join(beside, [*self.keys, "_b"])
        parts = [F.col("_back")] if back else []
        parts += [F.col("_rows")]
        parts += [F.col("_ahead")] if ahead else []
        outer = [c for c in beside.columns if c not in ("_before", "_back", "_ahead")]
        exploded = joined.select(
            *outer,
            F.col("_before"),
            F.size("_rows").alias("_size"),
            F.posexplode(F.concat(*parts) if len(parts) > 1 else F.col("_rows")).alias("_p", "_r"),
        )
        inside = F.col("_p") - back
        own = (inside >= 0) & (inside < F.col("_size"))
        if back or ahead:
            exploded = exploded.where(F.col("_r").isNotNull())
        return exploded.select(
            *self.keys,
            *[F.col(f"_r.{c}").alias(c) for c in self.columns],
            (F.col("_before") + inside).alias("i"),
            *[c for c in outer if c not in self.keys],
            *([own.alias("_own")] if back or ahead else []),
        )

    def window(self) -> WindowSpec:
        """Rows of a block, copies included, in order; needs no further shuffle."""
        return Window.partitionBy(*self.keys, "_b").orderBy("i")

    def shifted(self, shifts: Mapping[str, tuple[str, int]]) -> DataFrame:
        """`rows` with new columns ``(source, k)``: the source k positions earlier.

        Negative k looks ahead; beyond the ends of the series it is null.  A block's readings
        are in order already, so they are moved as arrays, without a sort of the rows.
        """
        reach = [k for _, k in shifts.values()]
        back, ahead = max([0, *reach]), max([0, *[-k for k in reach]])
        beside = self.offsets
        if back or ahead:
            beside = beside.join(self._edges(back, ahead), [*self.keys, "_b"])
        outer = [c for c in self.offsets.columns if c not in (*self.keys, "_before")]
        whole = [*(["_back"] if back else []), "_rows", *(["_ahead"] if ahead else [])]

        def moved(source: str, k: int) -> Column:
            """The block's readings of ``source``, each the one k positions before it."""
            full = F.concat(*[F.col(f"{c}.{source}") for c in whole])
            return F.slice(full, F.lit(back - k + 1), F.size("_rows"))

        cells = [F.col(f"_rows.{c}").alias(c) for c in self.columns]
        cells += [moved(c, k).alias(name) for name, (c, k) in shifts.items()]
        return (
            self.packed.join(beside, [*self.keys, "_b"])
            .select(*self.keys, "_before", *outer, F.posexplode(F.arrays_zip(*cells)).alias("_p", "_r"))
            .select(
                *self.keys,
                *[F.col(f"_r.{c}").alias(c) for c in self.columns],
                (F.col("_before") + F.col("_p")).alias("i"),
                *outer,
                *[F.col(f"_r.{name}").alias(name) for name in shifts],
            )
        )

    def _edges(self, back: int, ahead: int) -> DataFrame:
        """Per block, the ``back`` readings before it and the ``ahead`` after it.

        Padded with nulls at the ends of the series.  A block holds at least one
        reading, so as many neighbours as readings are enough.
        """
        rows, size = F.col("_rows"), F.size("_rows")
        blank = F.lit(None).cast(self.packed.schema["_rows"].dataType.elementType)
        tails = self.packed.select(
            *self.keys,
            "_b",
            F.slice(rows, F.greatest(size - back, F.lit(0)) + 1, F.lit(back)).alias("_tail"),
            F.slice(rows, F.lit(1), F.lit(ahead)).alias("_head"),
        )
        series = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy("_b")
        edges = []
        if back:
            near = F.flatten(F.collect_list("_tail").over(series.rowsBetween(-back, -1)))
            full = F.concat(F.array_repeat(blank, back), near)
            edges.append(F.slice(full, F.lit(-back), F.lit(back)).alias("_back"))
        if ahead:
            near = F.flatten(F.collect_list("_head").over(series.rowsBetween(1, ahead)))
            full = F.concat(near, F.array_repeat(blank, ahead))
            edges.append(F.slice(full, F.lit(1), F.lit(ahead)).alias("_ahead"))
        return tails.select(*self.keys, "_b", *edges)


def pack(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    totals: Mapping[str, str] | None = None,
) -> Blocks:
    """Cut series into blocks; ``block`` must not decrease along ``order``.

    ``totals`` maps a name to a column summed over the whole series; ``<name>_n`` counts
    its values, nulls left out.  Offsets are
    prefix sums over one row per block, so no task sees more of a series than one
    block's readings or its block summaries.
    """
    totals = dict(totals or {})
    keys = list(keys)
    columns = [*order, *[c for c in df.columns if c not in (*keys, *order)]]
    # A block number that cannot be null adds no filter of its own to the joins below,
    # so their plans stay equal and share the shuffle.
    number = F.coalesce(block, F.lit(0).cast("long")).alias("_b")
    packed = df.groupBy(*keys, number).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows")
    )
    plus = lambda a, x: a + F.coalesce(x, F.lit(0.0))
    summary = packed.select(
        *keys,
        "_b",
        F.size("_rows").cast("long").alias("_c"),
        *[
            F.aggregate(F.col(f"_rows.{c}").cast("array<double>"), F.lit(0.0), plus).alias(name)
            for name, c in totals.items()
        ],
        *[
            F.size(F.filter(F.col(f"_rows.{c}"), lambda x: x.isNotNull())).cast("long").alias(f"{name}_n")
            for name, c in totals.items()
        ],
    )
    series = Window.partitionBy(*(keys or [F.lit(0)]))
    offsets = summary.select(
        *keys,
        "_b",
        (F.sum("_c").over(series.orderBy("_b")) - F.col("_c")).alias("_before"),
        F.sum("_c").over(series).alias("n"),
        *[F.sum(name).over(series).alias(name) for t in totals for name in (t, f"{t}_n")],
    )
    return Blocks(keys, columns, packed, offsets)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    out: str,
    width: int = ROW_BLOCK,
    times: int = 1,
) -> DataFrame:
    """Sum of ``value`` up to and including each row, in ``position`` order per key.

    With ``times`` the sums are summed again, so often altogether.  A null adds nothing to
    later rows, as in SQL's window sums, but its own row is null.  What a block hands on is
    one number per summing: after L rows the m-th sum has grown by C(L + m - j - 1, m - j)
    times each j-th sum at the block's start, and by the block's own m-th sum.
    """
    blocks = pack(df, keys, [position], row_block(position, width))
    series = Window.partitionBy(*blocks.keys).orderBy("_b")
    zero, count = F.lit(0.0), F.size("_rows")
    number = F.transform(F.col(f"_rows.{value}"), lambda x: F.coalesce(x.cast("double"), zero))

    def grown(j: int, m: int) -> Column:
        """C(L + m - j - 1, m - j) for a block of L rows."""
        size, factor = F.col("_len").cast("double"), F.lit(1.0)
        for k in range(m - j):
            factor = factor * (size + k) / (k + 1)
        return factor

    sums = [F.lit(0.0)] * times
    state = F.struct(*[c.alias(f"s{m}") for m, c in enumerate(sums)])

    def step(s: Column, x: Column) -> Column:
        cells, last = [], x
        for m in range(times):
            last = s[f"s{m}"] + last
            cells.append(last.alias(f"s{m}"))
        return F.struct(*cells)

    carried = blocks.packed.select(
        *blocks.keys, "_b", count.alias("_len"), F.aggregate(number, state, step).alias("_own")
    )
    for m in range(times):
        gain = F.col(f"_own.s{m}")
        for j in range(m):
            gain = gain + grown(j, m) * F.col(f"_at{j}")
        carried = carried.withColumn("_gain", gain)
        carried = carried.withColumn(f"_at{m}", F.sum("_gain").over(series) - F.col("_gain"))
    starts = [f"_at{m}" for m in range(times)]
    rows = blocks.packed.join(carried.select(*blocks.keys, "_b", *starts), [*blocks.keys, "_b"]).select(
        *blocks.keys, "_b", *starts, F.explode("_rows").alias("_r")
    )
    rows = rows.select(*blocks.keys, "_b", *starts, "_r.*").withColumn("_sum", F.coalesce(F.col(value), zero))
    inside = Window.partitionBy(*blocks.keys, "_b").orderBy(position)
    for m in range(times):
        rows = rows.withColumn("_sum", F.col(f"_at{m}") + F.sum("_sum").over(inside))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.col("_sum"))).select(*df.columns, out)


def fan_out(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """Spread rows that are about to be multiplied over all tasks.

    The number is explicit: few small rows would otherwise be merged into one
    partition by their present size, and one task would then expand them all.
    """
    number = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(number, *columns)


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    block: Column,
    also: Sequence[str] = (),
) -> DataFrame:
    """Inner join of readings with a per-series table, safe for a dominant series.

    ``small`` is first spread over the blocks that occur in ``big``, so the join
    is on ``keys + also + block`` and no task receives more than a block per series.
    Spark still broadcasts the spread table where its measured size allows it.
    """
    tagged = big.withColumn("_b", block)
    spread = tagged.select(*keys, "_b").distinct().join(small, list(keys))
    return tagged.join(spread, [*keys, *also, "_b"]).drop("_b")
