"""Arrow batches between Spark and Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Bytes of a batch: rows may be long, and every task holds some copies of a batch.
BATCH_BYTES = "8m"


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with batches bounded in bytes as well as rows; the session keeps that setting."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)
