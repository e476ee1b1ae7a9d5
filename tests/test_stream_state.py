"""Streams with outer joins, profile versions, timers, and files of bounded batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import schemas, sinks, streaming

START = datetime(2024, 1, 1)


@pytest.fixture
def fed(spark, tmp_path):
    """Rows as a stream, one micro-batch per list; a marker row moves the watermark at the end."""

    def make(name, batches, schema, delay="0 seconds"):
        folder = tmp_path / name
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part={k}"))
        paths = f"{folder}/part=*"
        return streaming.stream_readings(spark, paths, spark.createDataFrame([], schema).schema, delay=delay, maxFilesPerTrigger="1")

    return make


def run(spark, tmp_path, stream, name):
    path = str(tmp_path / name)
    streaming.write_stream(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def at(hours):
    return START + timedelta(hours=hours)


def test_unmatched_forecasts_come_out_after_the_watermark(spark, fed, tmp_path):
    steps = "key string, profile_key string, ts timestamp, yhat double"
    tops = "key string, ts timestamp, peak double"
    forecasts = fed("f", [[("a", "a", at(h), 10.0 + h) for h in r] for r in (range(4), range(4, 8))], steps)
    peaks = fed("p", [[("a", at(h), 1.0) for h in (0, 2)], [("a", at(h), 1.0) for h in (4, 7)]], tops)
    got = run(spark, tmp_path, streaming.stream_join_forecast(forecasts, peaks), "joined")
    values = {(r.ts - START).seconds // 3600: r.value for r in got.collect()}
    assert values == {0: 11, 1: None, 2: 13, 3: None, 4: 15, 5: None, 6: None, 7: 18}
    assert got.count() == 8 and {r.dow for r in got.collect()} == {2}


def test_join_with_combinations(spark, fed, tmp_path):
    forecasts = fed("f", [[("a", "a", at(h), 10.0) for h in range(3)]], "key string, profile_key string, ts timestamp, yhat double")
    peaks = fed("p", [[("b", at(h), 2.0) for h in range(3)]], "key string, ts timestamp, peak double")
    combos = spark.createDataFrame([("a", "a", "b", "b")], schemas.COMBOS)
    got = run(spark, tmp_path, streaming.stream_join_forecast(forecasts, peaks, combos), "joined").collect()
    assert [(r.f_key, r.key, r.value) for r in got] == [("a", "b", 12.0)] * 3


def index_rows(hours, values):
    return [("k", at(h), v) for h, v in zip(hours, values)]


def test_profile_versions_follow_and_replay(spark, fed, tmp_path):
    schema = "key string, ts timestamp, ri double"
    batches = [index_rows([0, 1, 168], [1.0, 2.0, 3.0]), index_rows([0, 5], [5.0, None]), index_rows([168 * 2], [9.0])]
    path = str(tmp_path / "profile")
    stream = fed("i", batches, schema)
    streaming.write_stream_profile(stream, path, f"{path}-checkpoint").awaitTermination()
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    rows = lambda df: sorted((r.key, r.dow, r.hour, r.pi) for r in df.collect())
    newest = streaming.read_profile(spark, path)
    assert rows(newest) == rows(op.periodic_index(whole))
    first = rows(streaming.read_profile(spark, path, 0))
    assert first == [("k", 2, 0, 2.0), ("k", 2, 1, 2.0)]
    before = rows(newest)
    streaming.merge_profile(spark.createDataFrame(batches[2], schema), 2, path)  # a repeated batch
    assert rows(streaming.read_profile(spark, path)) == before
    readings = fed("r", [[("k", at(0), 10.0)]], schemas.READINGS)
    out = str(tmp_path / "adjusted")
    streaming.write_stream_adjusted(readings, path, out, f"{out}-checkpoint").awaitTermination()
    assert [r.adjusted for r in spark.read.parquet(out).collect()] == [pytest.approx(10 / 4.5)]


def test_trigger_ignores_nulls_and_clears_by_timer(spark, fed, tmp_path):
    values = [1.0, None, 2.0, 3.0, 4.0]
    minutes = [0, 30, 31, 60, 90]
    first = [("k", START + timedelta(minutes=m), v) for m, v in zip(minutes, values)]
    late = [("k", START + timedelta(minutes=1), 100.0), ("k", at(40), 7.0)]
    stream = fed("c", [first, [("k", at(30), 1.0)], late], schemas.READINGS, "1 hour")
    got = run(spark, tmp_path, streaming.stream_count_trigger(stream), "ma").collect()
    assert [((r.ts - START).seconds // 60, r.ma) for r in got] == [(0, 2.5)]


def test_out_of_order_readings_count_together(spark, fed, tmp_path):
    order = [3, 0, 2, 1]
    batches = [[("k", START + timedelta(minutes=30 * m), float(m))] for m in order]
    got = run(spark, tmp_path, streaming.stream_count_trigger(fed("o", batches, schemas.READINGS, "1 day")), "ma").collect()
    assert [(r.ts, r.ma) for r in got] == [(START, 1.5)]


def test_line_files_hold_bounded_batches(spark, series, tmp_path):
    path = str(tmp_path / "lines")
    table = series({k: [float(i) for i in range(300)] for k in "abc"}).repartition(2)
    broken = table.withColumn("value", F.when(F.col("value") == 299, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_line_batches(broken, path, "energy", 100)
    sinks.write_line_batches(table, path, "energy", 100)
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    assert lines.count() == lines.select("value").distinct().count() == 900
    assert lines.groupBy("file").count().agg(F.max("count")).first()[0] <= 100
