"""Edges between reads that share a k-mer, as stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_edges(survivors: DataFrame) -> DataFrame:
    """(u, v), distinct: from the largest read_id of each k-mer to its other reads. n reads give n - 1 edges, not n**2.

    The centre is a combined aggregate joined back, so that a k-mer of a repeat is a skewed join key, which adaptive
    execution splits, and never one task's group.
    """
    pairs = survivors.select("kmer", "read_id")
    centre = pairs.groupBy("kmer").agg(F.max("read_id").alias("u"), F.min("read_id").alias("low")).where("low < u").select("kmer", "u")
    return pairs.join(centre, "kmer").where("read_id <> u").select("u", F.col("read_id").alias("v")).distinct()
