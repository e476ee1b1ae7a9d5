from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import sinks, streaming
from tests.conftest import START


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of parquet files, read one per micro-batch in the order written."""
    folder = tmp_path / "in"

    def stream(*batches, delay="1 day"):
        for batch in batches:
            batch.coalesce(1).write.mode("append").parquet(str(folder))
        return streaming.stream_readings(
            spark, str(folder), batches[0].schema, delay=delay, maxFilesPerTrigger="1"
        )

    return stream


@pytest.fixture
def run(spark, tmp_path):
    def finish(stream):
        path = str(tmp_path / "out")
        streaming.write_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    return finish


def days(series, first, count, key="m"):
    start = START + timedelta(days=first)
    return series({key: [float((i * 7) % 11) for i in range(48 * count)]}, start=start)


def closed(batch, newest, delay=timedelta(days=1)):
    return batch.where(F.col("ts") + F.expr("INTERVAL 120 MINUTES") <= F.lit(newest - delay))


def same(a, b, digits=9):
    rounded = [
        df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])
        for df in (a, b)
    ]
    assert rounded[0].count() > 0
    assert rounded[0].exceptAll(rounded[1]).count() == 0
    assert rounded[1].exceptAll(rounded[0]).count() == 0


def test_moving_average_equals_batch(series, feed, run):
    parts = [days(series, d, 1) for d in range(4)]
    whole = op.union_series(*parts)
    got = run(streaming.stream_moving_average(feed(*parts)))
    newest = START + timedelta(days=4, minutes=-30)
    same(got, closed(op.moving_average(whole), newest))


def test_raw_index_equals_batch(series, feed, run):
    parts = [days(series, d, 1) for d in range(4)]
    got = run(streaming.stream_raw_index(feed(*parts)))
    newest = START + timedelta(days=4, minutes=-30)
    same(got, closed(op.raw_index(op.union_series(*parts)), newest))


def test_order_within_the_delay_does_not_matter(series, feed, run):
    day = days(series, 0, 1)
    noon = START + timedelta(hours=12)
    parts = [day.where(F.col("ts") >= noon), day.where(F.col("ts") < noon), days(series, 1, 2)]
    got = run(streaming.stream_moving_average(feed(*parts)))
    newest = START + timedelta(days=3, minutes=-30)
    same(got, closed(op.moving_average(op.union_series(*parts)), newest))


def test_late_readings_are_dropped(series, feed, run):
    late = days(series, 0, 1, key="late")
    parts = [days(series, 5, 1), days(series, 6, 2), late]
    got = run(streaming.stream_moving_average(feed(*parts)))
    assert {r.key for r in got.select("key").distinct().collect()} == {"m"}


def test_count_trigger_emits_at_every_fourth_reading(series, feed, run):
    once = days(series, 0, 1)
    got = run(streaming.stream_count_trigger(feed(once)))
    same(got, op.moving_average(once))


def test_count_trigger_counts_repeated_readings(series, feed, run):
    four = series([1, 2, 3, 4])
    got = run(streaming.stream_count_trigger(feed(four, four)))
    full = got.where(F.col("ts") == F.lit(START)).collect()
    assert len([r for r in full if r.ma == 2.5]) >= 2


def test_profile_in_complete_mode(spark, series, feed, tmp_path):
    parts = [days(series, d, 1).withColumnRenamed("value", "ri") for d in (0, 7, 1)]
    path = str(tmp_path / "profile")
    streaming.write_stream_batches(
        streaming.stream_periodic_index(feed(*parts)), path, str(tmp_path / "c"), "complete"
    ).awaitTermination()
    batches = spark.read.parquet(path)
    newest = batches.agg(F.max("batch")).first()[0]
    got = batches.where(F.col("batch") == newest).drop("batch")
    same(got, op.periodic_index(op.union_series(*parts)))


def test_static_profile_joins(series, feed, run):
    readings = days(series, 0, 8)
    profile = op.periodic_index(op.raw_index(readings)).cache()
    got = run(streaming.stream_adjusted(feed(readings), profile))
    same(got, op.adjusted_series(readings, profile).drop("profile_key"))


def test_static_peaks(series, feed, run):
    readings = days(series, 0, 8)
    profile = op.periodic_index(op.raw_index(readings)).cache()
    got = run(streaming.stream_peaks(feed(readings), profile))
    same(got, op.peaks(readings, profile).drop("profile_key"))


def test_running_wordcount(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    (folder / "a.txt").write_text("to be or not\nto be\n")
    out = str(tmp_path / "words")
    counts = streaming.stream_wordcount(streaming.stream_lines(spark, str(folder)))
    streaming.write_stream_batches(counts, out, str(tmp_path / "c")).awaitTermination()
    (folder / "b.txt").write_text("To go")
    streaming.write_stream_batches(counts, out, str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    first = max(r.batch for r in rows if r.word == "or")
    assert {(r.word, r["count"]) for r in rows if r.batch == first} >= {("to", 2), ("be", 2)}
    assert max(r["count"] for r in rows if r.word == "to") == 3


def test_dayslot_files(spark, tmp_path, run):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "7252.csv").write_text("7252,19544,0.052\n7252,19543,0.052\n7252,19501,0.033\n")
    got = run(streaming.stream_dayslot(spark, str(folder)))
    assert sorted(r.ts.hour for r in got.collect()) == [0, 21, 22]


def test_points_sink(spark, series, feed, tmp_path):
    path = str(tmp_path / "points")
    streaming.write_stream_points(
        feed(days(series, 0, 1)), path, str(tmp_path / "c"), "addpeaks1"
    ).awaitTermination()
    same(spark.read.parquet(path).select("key", "ts_ms", "value"),
         sinks.points(days(series, 0, 1), "addpeaks1").drop("measurement"))


def test_endless_grid(spark, tmp_path):
    grid = streaming.stream_time_grid(spark, START, "30 minutes", rows=4)
    query = grid.writeStream.format("memory").queryName("grid").start()
    try:
        while query.lastProgress is None or spark.table("grid").count() < 4:
            query.awaitTermination(1)
    finally:
        query.stop()
    got = sorted(r.ts for r in spark.table("grid").collect())[:4]
    assert got == [START + timedelta(minutes=30 * k) for k in range(4)]


def test_index_aligned_to_two_hours(series, feed, run):
    parts = [days(series, d, 1) for d in range(4)]
    got = run(streaming.stream_raw_index(feed(*parts), align_minutes=120))
    newest = START + timedelta(days=4, minutes=-30)
    same(got, closed(op.raw_index(op.union_series(*parts), align_minutes=120), newest))


def test_pairs_of_profiles(spark, series, feed, run):
    parts = [op.union_series(days(series, d, 4, "a"), days(series, d, 4, "b")) for d in (0, 4)]
    whole = op.union_series(*parts)
    profile = op.periodic_index(op.raw_index(whole)).cache()
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b")], "key string, profile_key string")
    got = run(streaming.stream_peaks(feed(*parts), profile, pairs))
    same(got, op.peaks(whole, profile, pairs))


def test_peaks_set_on_a_stored_forecast(spark, series, feed, run):
    readings = days(series, 0, 8)
    profile = op.periodic_index(op.raw_index(readings)).cache()
    forecast = op.forecast_arima(op.adjusted_series(readings, profile)).cache()
    peaks = streaming.stream_peaks(feed(readings), profile)
    got = run(streaming.stream_add_peaks(peaks, forecast))
    same(got, op.add_peaks(forecast, op.peaks(readings, profile)))


def test_peaks_on_a_null_forecast_stay(spark, series, feed, run):
    readings = days(series, 0, 1)
    forecast = readings.select("key", F.col("key").alias("profile_key"), "ts", F.lit(None).cast("double").alias("yhat"))
    peaks = streaming.stream_peaks(feed(readings), op.periodic_index(op.raw_index(readings)).cache())
    got = run(streaming.stream_add_peaks(peaks, forecast)).collect()
    assert got and all(r.value is None for r in got)


def test_dayslot_rejects_have_their_own_stream(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("7252,19544,0.052\n7252,x,0.1\n")
    (folder / "b.csv").write_text("7252,19543,\n7252,19501,0.033\n")
    good, bad = streaming.stream_dayslot(spark, str(folder), rejects=True, maxFilesPerTrigger="1")
    for name, part in (("good", good), ("bad", bad)):
        streaming.write_stream(part, str(tmp_path / name), str(tmp_path / f"{name}-c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    rows = spark.read.schema(bad.schema).parquet(str(tmp_path / "bad")).collect()
    assert {(r.code, r.value) for r in rows} == {("x", "0.1"), ("19543", None)}
