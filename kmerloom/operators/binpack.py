"""Balanced partitions: contiguous ranges of component ids of about equal numbers of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.prefix import exclusive_sum


def component_partitions(labels: DataFrame, parts: int = 16) -> DataFrame:
    """(comp_id, n, part_id): with q the reads per part rounded down and E the reads in components of smaller id, a
    component is in part E div q, at most the last; with fewer reads than parts all are in the last."""
    sizes = labels.groupBy("comp_id").agg(F.count("*").alias("n"))
    q = labels.count() // parts
    part = F.expr(f"least({parts - 1}, before div {q})") if q else F.lit(parts - 1)
    return exclusive_sum(sizes, ["comp_id"], "n", "before").select("comp_id", "n", part.cast("int").alias("part_id"))


def partition_manifest(labels: DataFrame, reads: DataFrame, partitions: DataFrame) -> DataFrame:
    """(part_id, read_id): the reads each partition receives.

    A pair goes to the partition of its first mate's component and, if its mates' components differ, again to that of
    the second, even if that is the same partition. Single reads go out once.
    """
    mine = labels.select("read_id", F.col("comp_id").alias("own"))
    mate = labels.select(F.col("read_id").alias("mate_id"), F.col("comp_id").alias("other"))
    comps = F.explode(F.array_distinct(F.array("own", F.coalesce("other", "own"))))
    placed = reads.select("read_id", "mate_id").join(mine, "read_id").join(mate, "mate_id", "left").select("read_id", comps.alias("comp_id"))
    return placed.join(partitions.select("comp_id", "part_id"), "comp_id").select("part_id", "read_id")
