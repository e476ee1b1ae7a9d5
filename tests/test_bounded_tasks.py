"""No task holds the rows that a step adds: plans, and results against plain Python."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import sources
from meterloom.functions.blocks import pack, time_block, with_halo

HOUR = timedelta(hours=1)
READINGS = "key string, ts timestamp, value double"


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def expected(rows, scope, fill):
    """The grid of every key by brute force; readings without a time keep one row."""
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    times = [floor(t) for _, t, _ in rows if t]
    out = {}
    for key in {k for k, _, _ in rows}:
        own = [floor(t) for k, t, _ in rows if k == key and t]
        if any(k == key and t is None for k, t, _ in rows):
            out[key, None] = None
        span = times if scope == "global" else own
        at = min(span) if span else None
        while at is not None and at <= max(span):
            out[key, at] = None
            at += HOUR
    for key, t, value in rows:
        if value is not None:
            slot = key, floor(t) if t else None
            out[slot] = (out[slot] or 0.0) + value
    return {slot: fill if v is None else v for slot, v in out.items()}


def test_gap_fill_adds_the_empty_slots_last(spark, capsys):
    start = datetime(1969, 12, 20, 5, 10)
    rows = [
        ("a", start, 1.0), ("a", start, 2.5), ("a", start + 900 * HOUR, 4.0), ("a", start + 901 * HOUR, None),
        ("b", start + 30 * HOUR, 8.0), ("b", None, 16.0), ("b", None, None),
        (None, start + 2 * HOUR, 32.0), (None, start + 1500 * HOUR, 64.0), ("c", None, None),
    ]
    df = spark.createDataFrame(rows, READINGS)
    for scope in ("global", "series"):
        filled = sources.gap_fill(df, "1 hour", scope=scope, fill=-1.0)
        got = filled.collect()
        assert {(r.key, r.ts): r.value for r in got} == expected(rows, scope, -1.0)
        assert len(got) == len(expected(rows, scope, -1.0))
        text = plan(filled, capsys)
        assert text.index("Generate") < text.index("Exchange")


def test_forecast_passes_sort_no_rows(spark, series, capsys):
    """Rows of a block are in order: neither lags nor the sums of a series sort them again."""
    data = {"a": [float(k * k % 7) for k in range(40)], "b": [1.0, 2.0, 4.0]}
    text = plan(op.backtest(series(data), keys=["key"], value="value"), capsys)
    assert "SortAggregate" not in text and "lag(" not in text


def test_shifted_columns(spark, series):
    data = {"a": [float(k) for k in range(9)], "b": [5.0]}
    blocks = pack(series(data), ["key"], ["ts"], time_block("ts", "2 hours"))
    for shifts in ({"p": ("value", 2), "q": ("value", -3)}, {"p": ("value", 1), "q": ("value", 0)}):
        got = {(r.key, r.i): (r.p, r.q) for r in blocks.shifted(shifts).collect()}
        at = lambda values, i: values[i] if 0 <= i < len(values) else None
        assert got == {
            (key, i): tuple(at(values, i - k) for _, k in shifts.values())
            for key, values in data.items() for i in range(len(values))
        }


def test_shifts_of_nothing(spark, series):
    rows = pack(series({"a": [1.0, 2.0]}), ["key"], ["ts"], time_block("ts")).shifted({"same": ("value", 0)})
    assert rows.where(F.col("same") != F.col("value")).count() == 0 and rows.count() == 2


def test_halo_rows(spark, capsys):
    """Copies of edge rows, found by conditions that Spark compiles, not by a filter over an array."""
    rows = spark.createDataFrame([(i,) for i in (*range(-5, 12), None)], "i long")
    for before, after in ((0, 2), (1, 0), (2, 2), (3, 3)):
        haloed = with_halo(rows, "i", 4, before, after)
        got = sorted((r.i, r["_blk"], r["_own"]) for r in haloed.collect())
        want = [
            (i, blk, blk == i // 4)
            for i in range(-5, 12) for blk in (i // 4 - 1, i // 4, i // 4 + 1)
            if blk * 4 - before <= i < blk * 4 + 4 + after
        ]
        assert got == sorted(want)
        assert "filter(" not in plan(haloed, capsys)
