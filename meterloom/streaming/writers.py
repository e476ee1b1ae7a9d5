"""Starting streaming queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.sinks.writers import points
from meterloom.streaming.streams import stream_adjusted


def write_stream(
    df: DataFrame, path: str, checkpoint: str, partition_by: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Append rows as parquet files, each exactly once."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)


def write_stream_points(
    df: DataFrame,
    path: str,
    checkpoint: str,
    measurement: str | Column,
    ts: str = "ts",
    value: str = "value",
    available_now: bool = True,
) -> StreamingQuery:
    """Tagged points, one folder per measurement."""
    return write_stream(
        points(df, measurement, ts, value), path, checkpoint, "measurement", available_now
    )


def write_stream_batches(
    df: DataFrame, path: str, checkpoint: str, mode: str = "update", available_now: bool = True
) -> StreamingQuery:
    """Rows of each micro-batch in a folder ``batch=<id>``.

    Serves results that change (update or complete mode).  A repeated batch
    overwrites its own folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()


_CELL = ("key", "dow", "hour")
_CELLS = "key string, dow int, hour int, total double, n long"


def merge_profile(batch: DataFrame, number: int, path: str, ts: str = "ts", value: str = "ri") -> None:
    """Write version ``number`` of a profile: version ``number - 1`` and the index values of ``batch``.

    A version holds sums and counts of 168 cells per key, which add up.  It depends on its
    predecessor and its batch alone, so a repeated batch writes the same version again.
    """
    cells = batch.groupBy("key", F.dayofweek(ts).alias("dow"), F.hour(ts).alias("hour")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count(value).alias("n")
    )
    if number:
        before = batch.sparkSession.read.schema(_CELLS).parquet(f"{path}/version={number - 1}")
        cells = before.unionByName(cells).groupBy(*_CELL).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    cells.write.mode("overwrite").parquet(f"{path}/version={number}")


def write_stream_profile(
    index: DataFrame, path: str, checkpoint: str, ts: str = "ts", value: str = "ri", available_now: bool = True
) -> StreamingQuery:
    """Keep the profile of a stream of raw indices up to date, one version per micro-batch.

    The stream itself needs no state.  A new checkpoint starts a new profile, so give it a
    path of its own.
    """

    def save(batch: DataFrame, number: int) -> None:
        merge_profile(batch, number, path, ts, value)

    writer = index.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()


def read_profile(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(key, dow, hour, pi)`` of a version, the newest one by default; cells without values are null."""
    versions = spark.read.schema(f"{_CELLS}, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    mean = F.try_divide(F.col("total"), F.col("n"))
    return versions.where(F.col("version") == version).select(*_CELL, mean.alias("pi"))


def write_stream_adjusted(
    readings: DataFrame,
    profile_path: str,
    path: str,
    checkpoint: str,
    ts: str = "ts",
    value: str = "value",
    available_now: bool = True,
) -> StreamingQuery:
    """`stream_adjusted` against the newest profile there is when a micro-batch begins.

    Each micro-batch goes to its own folder with the version it used; a repeated one
    overwrites its folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        profile = read_profile(batch.sparkSession, profile_path)
        adjusted = stream_adjusted(batch, profile, None, ts, value)
        adjusted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = readings.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(save).start()
