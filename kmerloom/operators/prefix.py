"""Prefix sums and dense ids over a whole table without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.storage import discard, is_stored, materialize


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def exclusive_sums(df: DataFrame, order: list[str], sums: dict[str, str | None]) -> DataFrame:
    """df with a column for each of ``sums``: of that column's values (of ones if None) the sum over all rows before it
    in ``order``.

    Rows are range-partitioned on ``order``, which should be a key; windows stay inside a range and the sums of whole
    ranges, one row per partition, are added on top. df is stored first unless it is a stored table, since finding the
    ranges reads it once more.
    """
    part, base, own = (_free(df, x) for x in ("range", "base", "own"))
    value = {out: F.col(v) if v else F.lit(1).cast("long") for out, v in sums.items()}
    stored = df if is_stored(df) else materialize(df, "unranged")
    ranged = materialize(stored.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    if stored is not df:
        discard(stored)
    whole = ranged.groupBy(part).agg(*(F.sum(v).alias(own + out) for out, v in value.items()))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    before = whole.select(part, *(F.coalesce(F.sum(own + out).over(earlier), F.lit(0)).alias(base + out) for out in sums))
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumns({own + out: F.coalesce(F.sum(v).over(inside), F.lit(0)) for out, v in value.items()}).join(F.broadcast(before), part)
    return summed.select(*df.columns, *((F.col(base + out) + F.col(own + out)).alias(out) for out in sums))


def exclusive_sum(df: DataFrame, order: list[str], value: str | None, out: str) -> DataFrame:
    """df with the column ``out``: the sum of ``value`` (of ones if None) over all rows before it in ``order``."""
    return exclusive_sums(df, order, {out: value})


def dense_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the column ``out``: 0, 1, 2, ... in ``order``, which must be a key of df."""
    return exclusive_sum(df, order, None, out)
