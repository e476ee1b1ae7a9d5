"""The driver's queries against their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
CHECKED = [
    "read_dayslot",
    "gap_fill",
    "raw_index",
    "periodic_index",
    "peaks_paired",
    "difference_seasonal",
    "fit_thermal_ar",
    "forecast_arima",
    "backtest_users",
    "add_peaks_combos",
    "synth_readings",
    "wordcount",
    "stream_raw_index",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, db.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 840


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
