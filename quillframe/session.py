"""What every operator may need of a session: the folder that executors share, and lineage cut through tables in it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes the shuffle files of a finished SQL execution where this is set.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names.

    Where none is named a local master gets a temporary folder; a cluster gets an error, since its executors
    would write to folders that no one else sees.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_quillframe_folder"):
        context._quillframe_folder = tempfile.mkdtemp(prefix="quillframe-shared-")
    return context._quillframe_folder


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of one action; then the caller's own again."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage with a table in the shared folder.

    The shuffles that made it go with the execution; the table goes when the driver's JVM ends, or earlier by ``discard``.
    """
    path = f"{shared_folder(spark).rstrip('/')}/quillframe-{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    with setting(spark, CLEAN_SHUFFLES, "true"):
        df.write.option("compression", "zstd").parquet(f"{path}/rows")
    out = spark.read.schema(df.schema).parquet(f"{path}/rows")
    out._quillframe_path = path
    return out


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Make a folder that is deleted when the driver's JVM ends (only what exists can be marked so)."""
    system, at = _filesystem(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        system, at = _filesystem(table.sparkSession, table._quillframe_path)
        system.delete(at, True)


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``stored`` under the name of what it is for: each step of a plan starts from a table, not from its history."""
    return stored(spark, df, "step")


#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``most`` rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
