"""Session settings the operators rely on, and staging of intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="meterloom-ship-")) / "meterloom"
    context.addPyFile(
        shutil.make_archive(str(archive), "zip", root_dir=package.parent, base_dir=package.name)
    )
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes.

    UTC, adaptive plans, and a realistic factor from file to memory size: columns of
    regular timestamps shrink so much in parquet that a table of readings would
    otherwise pass for small enough to broadcast.
    """
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "20.0")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    return spark


def get_spark(app: str = "meterloom", **conf: str) -> SparkSession:
    """Session with UTC pinned; keyword names use ``_`` for ``.`` in setting names."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="meterloom-")
    return _LOCAL_DIRS[app]


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as parquet to a new folder under the shared one; returns its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/meterloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage at a point several later jobs start from, and survives the
    loss of executors because the files do not live on them.
    """
    path = write_table(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)
