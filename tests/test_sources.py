from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterloom import schemas, sources
from tests.conftest import START


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    "code, base, label, expected",
    [
        ("19548", 0, "end", datetime(2009, 7, 16, 0, 0)),
        ("19544", 0, "end", datetime(2009, 7, 15, 22, 0)),
        ("19544", 1, "end", datetime(2009, 7, 14, 22, 0)),
        ("20101", 1, "pair", datetime(2009, 7, 20, 0, 0)),
        ("20102", 1, "pair", datetime(2009, 7, 20, 0, 30)),
    ],
)
def test_dayslot_codes(spark, tmp_path, code, base, label, expected):
    path = write(tmp_path / "a.csv", f"7252,{code},0.052\n")
    row = sources.read_dayslot(spark, path, day_base=base, slot_label=label).first()
    assert (row.key, row.ts, row.value) == ("7252", expected, 0.052)


def test_day_201_is_a_monday(spark, tmp_path):
    path = write(tmp_path / "a.csv", "7252,20101,1\n")
    readings = sources.read_dayslot(spark, path, slot_label="pair")
    assert readings.select(F.dayofweek("ts")).first()[0] == 2


def test_header_and_bad_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", '"Col0","Col1","Col2"\n1,19501,0.5\n2,19x01,1\n3,19502,none\n')
    good, bad = sources.read_dayslot(spark, path, header=True, rejects=True)
    assert [r.key for r in good.collect()] == ["1"]
    assert sorted(tuple(r) for r in bad.collect()) == [("2", "19x01", "1"), ("3", "19502", "none")]
    # Without the option the header line is a reject, not an error.
    good, bad = sources.read_dayslot(spark, path, rejects=True)
    assert (good.count(), bad.count()) == (1, 3)


def test_split_form(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Col0,Col1day,Col1min,Col2\n7252,195,01,0.033\n7252,195,44,0.052\n")
    got = sources.read_dayslot(spark, path, split=True, header=True).orderBy("ts").collect()
    assert [(r.ts.hour, r.value) for r in got] == [(0, 0.033), (22, 0.052)]


def test_weather(spark, tmp_path):
    path = write(tmp_path / "w.csv", "1,2013-01-01,0,0.4,-3.5\n")
    row = sources.read_weather(spark, path).first()
    assert (row.meter_id, str(row.date), row.hour, row.reading, row.temperature) == (
        1, "2013-01-01", 0, 0.4, -3.5,
    )


def test_weather_rejects(spark, tmp_path):
    bad = [
        ("x", "2013-01-01", "0", "1", "2"), ("1", "2013-13-01", "0", "1", "2"), ("1", "2013", "0", "1", "2"),
        ("1", "2013-01-01", "24", "1", "2"), ("1", "2013-01-01", "0", "none", "2"), ("1", "2013-01-01", "0", None, "2"),
        ("1", "2013-01-01", "0", None, None),
    ]
    lines = [",".join(x or "" for x in row) for row in bad[:-1]] + ["1,2013-01-01,0"]
    path = write(tmp_path / "w.csv", "\n".join(["1,2013-01-01,0,0.4,-3.5", *lines]) + "\n")
    good, rest = sources.read_weather(spark, path, rejects=True)
    assert good.schema.simpleString() == schemas.WEATHER.simpleString()
    assert [(r.meter_id, r.hour, r.temperature) for r in good.collect()] == [(1, 0, -3.5)]
    key = lambda row: tuple(x or "" for x in row)
    assert sorted(map(key, rest.collect())) == sorted(map(key, bad))
    none = sources.parse_weather(spark.createDataFrame([], schemas.WEATHER_TEXT))
    assert [part.count() for part in none] == [0, 0]


def test_activity_rejects(spark):
    day = ",".join(["1.5"] * 24)
    bad = [f"x|{day}|{day}", f"1|{day}", f"1|{day}|{day}|{day}", f"1|1,2|{day}", f"1|{day}|{day[:-3]}no", "", None]
    lines = spark.createDataFrame([(f"7|{day}|{day}",), *[(b,) for b in bad]], "value string")
    good, rest = sources.parse_activity(lines, rejects=True)
    assert [(r.meter_id, len(r.mean), r.std[23]) for r in good.collect()] == [(7, 24, 1.5)]
    assert sorted(r.value or "" for r in rest.collect()) == sorted(b or "" for b in bad)


def test_temperature_seed_of_a_folder(spark, tmp_path):
    write(tmp_path / "b.txt", "7|7\n")
    write(tmp_path / "a.txt", "1|2\n" + "9|9\n" * 50)
    got = sources.read_temperature_seed(spark, str(tmp_path)).orderBy("i").collect()
    assert [(r.i, r.temp) for r in got] == [(0, 1.0), (1, 2.0)]
    write(tmp_path / "none.txt", "")
    assert sources.read_temperature_seed(spark, str(tmp_path / "none.txt")).count() == 0


def test_temperature_seed_takes_the_first_line(spark, tmp_path):
    path = write(tmp_path / "t.txt", "1.5|2.5|-3\n9|9|9|9\n")
    got = sources.read_temperature_seed(spark, path).orderBy("i").collect()
    assert [(r.i, r.temp) for r in got] == [(0, 1.5), (1, 2.5), (2, -3.0)]


def test_grid_ranges(spark):
    hi = START + timedelta(hours=2)
    got = sources.time_grid_range(spark, START.replace(microsecond=9), hi, "30 minutes")
    rows = got.orderBy("ts").collect()
    assert [r.ts for r in rows] == [START + timedelta(minutes=30 * k) for k in range(5)]
    assert {r.value for r in rows} == {0.0}


def test_grid_is_the_same_for_any_block(spark):
    bounds = spark.createDataFrame(
        [("a", START, START + timedelta(days=9, minutes=10)), ("b", START, START)],
        "key string, lo timestamp, hi timestamp",
    )
    whole = sources.time_grid(bounds, "1 hour", block="1000 days")
    cut = sources.time_grid(bounds, "1 hour", block="7 hours")
    assert whole.count() == cut.count() == 9 * 24 + 1 + 1
    assert whole.exceptAll(cut).count() == 0


def test_gap_fill(spark, series):
    readings = series({"a": [1, None, 3], "b": [None, 5, None]})
    twice = readings.unionByName(readings)
    got = {(r.key, r.ts): r.value for r in sources.gap_fill(twice).collect()}
    half = timedelta(minutes=30)
    assert [got["a", START + k * half] for k in range(3)] == [2.0, 0.0, 6.0]
    assert [got["b", START + k * half] for k in range(3)] == [0.0, 10.0, 0.0]
    own = sources.gap_fill(readings, scope="series", fill=-1.0)
    assert {(r.key, r.value) for r in own.collect()} == {("a", 1.0), ("a", -1.0), ("a", 3.0), ("b", 5.0)}


def test_schemas_are_explicit():
    assert schemas.READINGS.simpleString() == "struct<key:string,ts:timestamp,value:double>"
