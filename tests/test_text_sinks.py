from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import sinks


def test_wordcount(spark):
    lines = spark.createDataFrame([("To be, or not to be,--that",), ("  ",)], "text string")
    got = {r.word: r["count"] for r in op.wordcount(lines).collect()}
    assert got == {"to": 2, "be": 2, "or": 1, "not": 1, "that": 1}
    assert op.tokens(lines).count() == 7


def test_line_protocol_and_csv(series):
    readings = series({"a b": [1.5]})
    assert sinks.to_line_protocol(readings, "addpeaks1").first().value == (
        "addpeaks1,key=a\\ b value=1.5 1704067200000"
    )
    assert sinks.point_to_csv(readings).first().value == "1704067200000,a b,1.5"
    assert sinks.point_to_csv(readings, value_format="%.3f").first().value.endswith(",1.500")


def test_points_by_measurement(spark, series, tmp_path):
    path = str(tmp_path / "points")
    for name in op.MEASUREMENTS:
        sinks.write_points(series([1, 2, 3]), path, name)
    got = spark.read.parquet(path).groupBy("measurement").agg(F.sum("value").alias("s")).collect()
    assert {(r.measurement, r.s) for r in got} == {(m, 6.0) for m in op.MEASUREMENTS}


def test_line_files(spark, series, tmp_path):
    path = str(tmp_path / "lines")
    sinks.write_line_protocol(series([1, 2]), path, "m")
    assert spark.read.text(path).count() == 2
