import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import schemas
from tests.conftest import START


def test_constant(series, column):
    readings = series([2.0] * 8)
    assert column(op.moving_average(readings), "ma") == [2.0] * 5
    assert column(op.raw_index(readings), "ri") == [1.0] * 5


def test_ramp(series, column):
    readings = series([1, 2, 3, 4, 5])
    assert column(op.moving_average(readings), "ma") == [2.5, 3.5]
    assert column(op.raw_index(readings), "ri") == pytest.approx([0.4, 4 / 7])


def test_missing_slot_gives_no_full_window(series):
    readings = series([1, 2, None, 4, 5])
    assert op.moving_average(readings).count() == 0
    assert op.moving_average(readings, points=3).count() == 2


def test_zero_average_passes_the_reading(series, column):
    assert column(op.raw_index(series([0, 0, 0, 0])), "ri") == [0.0]
    assert column(op.raw_index(series([3, -1, -1, -1])), "ri") == [3.0]


def test_alignment(series):
    readings = series([1.0] * 20)
    aligned = op.raw_index(readings, align_minutes=120)
    assert {r.ts.hour % 2 for r in aligned.collect()} == {0}
    assert aligned.count() == 5


def test_blocks_do_not_change_results(series):
    rng = random.Random(5)
    values = {k: [rng.random() if rng.random() < 0.9 else None for _ in range(400)] for k in "ab"}
    values["hot"] = [rng.random() for _ in range(1000)]
    readings = series(values)
    for make in (
        lambda b: op.moving_average(readings, block=b),
        lambda b: op.raw_index(readings, method="centered", block=b),
        lambda b: op.centered_ma(readings, block=b),
        lambda b: op.difference(readings, lag=5, times=2, block=b),
        lambda b: op.center(readings, block=b),
    ):
        whole, cut = make("365 days").collect(), make("3 hours").collect()
        assert len(whole) == len(cut)
        for a, b in zip(sorted(whole, key=lambda r: (r.key, r.ts)), sorted(cut, key=lambda r: (r.key, r.ts))):
            assert a[:2] == b[:2]
            assert a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_centered_average_by_hand(series, column):
    rng = random.Random(2)
    x = [rng.random() for _ in range(60)]
    got = column(op.centered_ma(series(x, minutes=60)), "cma")
    expected = list(x)
    for i in range(12, 60 - 12):
        expected[i] = 0.5 * sum(x[i - 12 : i + 12]) / 24 + 0.5 * sum(x[i - 11 : i + 13]) / 24
    assert got == pytest.approx(expected)


def profile_of(spark, rows):
    return spark.createDataFrame(rows, schemas.PROFILE)


def test_periodic_index_modes(spark):
    index = spark.createDataFrame(
        [("m", START + timedelta(days=7 * w, minutes=30 * s), float(1 + w + s)) for w in range(3) for s in (0, 1)],
        "key string, ts timestamp, ri double",
    )
    mean = op.periodic_index(index).first()
    assert (mean.dow, mean.hour, mean.pi) == (2, 0, 2.5)
    assert op.periodic_index(index, "last_cycle").first().pi == 2.0


def test_normalize(spark):
    profile = profile_of(spark, [("m", 1, h, 2.0) for h in range(24)])
    assert {r.pi for r in op.normalize_index(profile).collect()} == {1.0}
    written = op.normalize_index(profile, as_written=True).orderBy("hour").collect()
    assert [r.pi for r in written] == pytest.approx([1 / i for i in range(1, 25)])


def test_normalized_profile_sums_to_24(spark):
    rng = random.Random(3)
    profile = profile_of(spark, [("m", d, h, rng.random()) for d in range(1, 8) for h in range(24)])
    sums = op.normalize_index(profile).groupBy("dow").agg(F.sum("pi").alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([24.0] * 7)


def test_peaks_and_adjusted(spark, series):
    readings = series({"a": [4.0] * 6, "b": [9.0] * 6})
    profile = profile_of(
        spark, [("a", 2, 0, 2.0), ("a", 2, 1, 0.0), ("b", 2, 0, 3.0), ("b", 2, 1, 3.0), ("b", 2, 2, 3.0)]
    )
    tops = op.peaks(readings, profile).where("key = 'a'").orderBy("ts").collect()
    assert [r.peak for r in tops] == [2.0, 2.0, 4.0, 4.0]  # hour 2 has no entry
    kept = op.adjusted_series(readings, profile).where("key = 'a'").collect()
    assert [r.adjusted for r in kept] == [2.0, 2.0]  # hour 1 has a zero entry
    pairs = spark.createDataFrame([("a", "b"), ("b", "b")], schemas.PAIRS)
    crossed = op.adjusted_series(readings, profile, pairs).groupBy("key", "profile_key").agg(
        F.sum("adjusted").alias("s")
    )
    assert {(r.key, r.profile_key, round(r.s, 6)) for r in crossed.collect()} == {
        ("a", "b", 8.0),
        ("b", "b", 18.0),
    }


def test_identities(spark, series):
    rng = random.Random(4)
    readings = series([rng.random() + 0.5 for _ in range(48 * 15)])
    profile = op.periodic_index(op.raw_index(readings))
    both = (
        op.peaks(readings, profile)
        .join(op.adjusted_series(readings, profile), ["key", "profile_key", "ts", "dow"])
        .join(readings, ["key", "ts"])
        .join(profile.withColumnRenamed("hour", "h"), ["key", "dow"])
        .where(F.hour("ts") == F.col("h"))
    )
    worst = both.agg(
        F.max(F.abs(F.col("peak") + F.col("pi") - F.col("value"))),
        F.max(F.abs(F.col("adjusted") * F.col("pi") - F.col("value"))),
        F.count("*"),
    ).first()
    assert worst[2] == 48 * 15 and max(worst[:2]) < 1e-12
