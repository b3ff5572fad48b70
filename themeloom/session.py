"""Spark session settings and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback_roots: dict[str, str] = {}


def local_session(cores: int | None = None, memory: str = "12g", app: str = "themeloom") -> SparkSession:
    """A session for one machine. On a cluster, use the session that spark-submit configures."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(4 * 1024 * 1024))
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .config("themeloom.scanPartitions", str(n))
        .getOrCreate()
    )


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster session without it is an
    error, because a folder of one machine is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/themeloom/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    if app not in _fallback_roots:
        _fallback_roots[app] = tempfile.mkdtemp(prefix="themeloom-")
    return _fallback_roots[app]


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder for one staged table."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query once it has ended, instead of when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to shared storage and return a scan of it.

    This cuts the lineage: losing an executor costs a re-read of some files, never a re-run of the
    plan behind them.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    with released_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables that ``stage`` has written and nothing will read again."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staging(spark: SparkSession) -> None:
    """Delete all staged tables of this application; for the end of a run whose results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as the session setting ``themeloom.scanPartitions`` says; unchanged without it.

    A file of one row group is read by one task however many splits it has. The caller knows whether files are such.
    """
    parts = df.sparkSession.conf.get("themeloom.scanPartitions", None)
    return df.repartition(int(parts), *keys) if parts else df
