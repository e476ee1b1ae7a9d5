from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import schemas, sinks
from meterloom.operators import synth


@pytest.fixture
def activity(spark):
    rows = [(m, [float(m)] * 24, [0.1] * 24) for m in (3, 5, 9)]
    return spark.createDataFrame(rows, schemas.ACTIVITY)


@pytest.fixture
def temperature(spark):
    return spark.createDataFrame([(i, float(i)) for i in range(36)], "i int, temp double")


def test_ids_are_not_cut_off(spark):
    assert op.synth_ids(spark, 10, 4).count() == 10


def test_assignment(spark, activity):
    ids = op.synth_ids(spark, 7)
    cyclic = op.synth_assign(ids, activity, mode="cyclic").orderBy("id").collect()
    assert [r.meter_id for r in cyclic] == [3, 5, 9, 3, 5, 9, 3]
    many = op.synth_assign(op.synth_ids(spark, 3000), activity, seed=1).groupBy("meter_id").count()
    assert all(800 < r["count"] < 1200 for r in many.collect())


def test_temperature_repeats_the_seed(spark, temperature):
    grid = op.synth_grid(op.synth_ids(spark, 2), "2013-12-31", 2)
    assert grid.count() == 2 * 48
    got = op.synth_temperature(grid, temperature, sigma=0).where("id = 0").orderBy("i").collect()
    assert [r.temp for r in got] == [float(i % 36) for i in range(48)]
    assert got[-1].date == date(2014, 1, 1) and got[-1].hour == 23
    noisy = op.synth_temperature(grid, temperature, seed=3)
    off = noisy.agg(F.stddev(F.col("temp") - F.pmod("i", F.lit(36)))).first()[0]
    assert 1.5 < off < 2.5


def test_load_curve(spark):
    df = spark.createDataFrame(
        [("a", date(2013, 1, 1), t) for t in (0.0, 11.0, 13.0, 19.0, 30.0)],
        "id string, date date, temp double",
    )
    got = op.thermal_load(df, x1=12, x2=18, y0=0.1).orderBy("temp").collect()
    knee = 0.1 - 0.0059 * 12
    expected = [0.1, 0.1 - 0.0059 * 11, knee + 0.0155, knee + 0.0155 * 6 + 0.2233, 9]
    assert [r.thermal for r in got] == pytest.approx([min(v, 0.2) for v in expected])


def test_peaks_are_amplified(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 1.5)], "id string, date int, load double")
    got = op.peak_amplify(df, 2.0).orderBy("load").collect()
    assert [r.load for r in got] == [0.5, 2.0]


def test_generated_rows_do_not_depend_on_partitioning(spark, activity, temperature):
    def make(partitions, shuffle):
        ids = op.synth_ids(spark, 20, partitions)
        ids = ids.repartition(shuffle) if shuffle else ids
        return op.synth_readings(ids, activity, temperature, "2013-01-01", 3, 1.4, seed=5)

    a, b = make(1, None), make(5, 3)
    assert a.count() == 20 * 72
    assert a.exceptAll(b).count() == 0
    other = op.synth_readings(op.synth_ids(spark, 20), activity, temperature, "2013-01-01", 3, 1.4, seed=6)
    assert a.join(other, ["id", "date", "hour"]).where(a.load != other.load).count() > 1000


def test_compact_and_long_forms_agree(spark, activity, temperature):
    """The one-row-per-series generator equals the chain of single operators."""
    ids, seed, curve = op.synth_ids(spark, 6), 9, {"x1": 10, "x2": 20, "y0": 0.1}
    made = op.synth_readings(ids, activity, temperature, "2013-01-01", 2, 1.5, seed=seed, **curve)
    steps = op.synth_grid(op.synth_assign(ids, activity, seed), "2013-01-01", 2)
    steps = op.synth_activity(op.synth_temperature(steps, temperature, seed=seed), seed=seed)
    steps = op.thermal_load(steps, seed=seed, **curve)
    steps = op.peak_amplify(steps.withColumn("load", F.col("activity") + F.col("thermal")), 1.5)
    both = made.join(steps.select("id", "date", "hour", F.col("load").alias("l"), F.col("temp").alias("t")), ["id", "date", "hour"])
    worst = both.agg(F.count("*"), F.max(F.abs(F.col("load") - F.col("l"))), F.max(F.abs(F.col("temp") - F.col("t")))).first()
    assert worst[0] == 6 * 48 and worst[1] < 1e-9 and worst[2] < 1e-9


def test_text_form(spark):
    df = spark.createDataFrame(
        [(4, date(2013, 1, 2), 7, 0.5, -1.25)], "id long, date date, hour int, load double, temp double"
    )
    assert sinks.to_synthetic_lines(df).first().value == "4|2013-01-02 7:00:00|0.500000|-1.250000"


def test_draws_are_even_and_independent(spark):
    """Moments of normal draws, also between neighbouring ids, hours and purposes."""
    rows = spark.range(200).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    rows = rows.select(
        op.gaussian(1, "a", "id", "i").alias("a"),
        op.gaussian(1, "a", F.col("id") + 1, "i").alias("b"),
        op.gaussian(1, "a", "id", F.col("i") + 1).alias("c"),
        op.gaussian(2, "a", "id", "i").alias("d"),
        op.gaussian(1, "b", "id", "i").alias("e"),
        op.uniform(1, "u", "id", "i").alias("u"),
        op.uniform(1, "u", F.col("id") + (1 << 40), "i").alias("w"),
    )
    got = rows.agg(
        F.avg("a").alias("mean"), F.stddev("a").alias("std"), F.skewness("a").alias("skew"), F.kurtosis("a").alias("tail"),
        *[F.corr("a", c).alias(c) for c in "bcde"], F.avg("u").alias("u"), F.corr("u", "w").alias("w"), F.min("u").alias("low"), F.max("u").alias("high"),
    ).first()
    assert abs(got["mean"]) < 0.03 and abs(got["std"] - 1) < 0.03 and abs(got["skew"]) < 0.06 and abs(got["tail"]) < 0.12
    assert all(abs(got[c]) < 0.03 for c in "bcde") and abs(got["u"] - 0.5) < 0.01 and abs(got["w"]) < 0.03
    assert 0 < got["low"] < 0.001 and 0.999 < got["high"] < 1


def test_many_draws_equal_single_ones(spark):
    """Draws made column by column, as a table of numbers and as one expression are the same."""
    ids = [0, 1, -7, (1 << 40) + 3, None]
    rows = spark.createDataFrame([(x, i) for x in ids for i in (0, 1, 71)], "id long, i int")
    got = synth.with_draw(rows, {"x": "a", "y": "b"}, 9, "id", "i")
    got = synth.with_gaussian(got, {"z": "c"}, -3, "id", "i").select(
        "*", synth.draw(9, "a", "id", "i").alias("x0"), synth.draw(9, "b", "id", "i").alias("y0"),
        op.gaussian(-3, "c", "id", "i").alias("z0"),
    )
    assert got.where("NOT (x <=> x0 AND y <=> y0 AND round(z, 9) <=> round(z0, 9))").count() == 0
    table = synth._normal_table(-3, "c", np.array(ids[:-1]), np.array([0, 1, 71]))
    want = {(r.id, r.i): r.z0 for r in got.where("id IS NOT NULL").collect()}
    assert {(x, i): table[k, j] for k, x in enumerate(ids[:-1]) for j, i in enumerate((0, 1, 71))} == pytest.approx(want)


def test_noise_is_compiled(spark, temperature, capsys):
    """Neither noise on rows nor whole synthetic series fold over arrays, which Spark does not compile."""
    grid = op.synth_grid(op.synth_ids(spark, 2), "2013-12-31", 2)
    op.synth_temperature(grid, temperature, seed=3).explain()
    assert "aggregate(" not in capsys.readouterr().out


def test_missing_means_temperatures_and_repeated_ids(spark):
    """An hour without a mean has no activity, one without a temperature the lowest load; ids may repeat."""
    means = [None, *[float(h) for h in range(1, 20)]]
    activity = spark.createDataFrame([(3, means, [0.0] * 24)], schemas.ACTIVITY)
    seed = spark.createDataFrame([(i, None if i == 2 else 15.0 + i) for i in range(30)], "i int, temp double")
    ids = spark.createDataFrame([(4,), (4,), (None,)], "id int")
    for sigma in (0, 0.5):
        curve = {"x1": 10, "x2": 20, "y0": 0.1, "temperature_sigma": sigma, "activity_sigma": sigma}
        made = op.synth_readings(ids, activity, seed, "2013-01-01", 2, 1.0, **curve)
        assert made.schema["id"].dataType.typeName() == "integer"
        rows = made.collect()
        assert len(rows) == 2 * 48 and all(r.id == 4 and r.load is not None for r in rows)
        got = {(r.date.day - 1) * 24 + r.hour: (r.load, r.temp) for r in rows}
        assert got[2][1] is None and got[32][1] is None
        assert all(0 <= got[i][0] <= 0.2 for i in (0, 20, 23, 24, 44))
        if not sigma:
            assert got[2][0] == 2.0
            assert [got[i][1] for i in (0, 29, 30)] == [15.0, 44.0, 15.0]
