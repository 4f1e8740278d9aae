"""Bounded, documented samples of labelled rows to fit a model on; models are applied to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo modulus; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def hashed_sample(keys: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of keys, those of the smallest hash of doc_id: a sample that doesn't depend on order."""
    return keys.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
