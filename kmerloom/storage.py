"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it back: the files outlive any executor,
are columnar and compressed, and later plans prune their columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes what a query shuffled when it ends, not when the driver's garbage collection comes to it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
    return _LOCAL_ROOT


def session_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/kmerloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{session_root(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session. DataFrames that were built on them can't be read any more."""
    _delete(spark, session_root(spark))


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once and return the stored table. What was shuffled for it is deleted with the end of the write."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._kmerloom_path = path
    return stored


def spread(df: DataFrame) -> DataFrame:
    """A stored table in at least as many partitions as there are cores, for work that multiplies its rows.

    Only tables too small to fill the cores are dealt anew; a large one has partitions enough and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_stored(df: DataFrame) -> bool:
    """Whether df is the whole result of ``materialize``, with no column or filter put on it since."""
    return hasattr(df, "_kmerloom_path")


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    path = getattr(df, "_kmerloom_path", None)
    if path:
        _delete(df.sparkSession, path)
