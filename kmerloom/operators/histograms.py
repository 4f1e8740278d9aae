"""Histograms over k-mer buckets, prefix sums and equal-frequency ranges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.arrow import map_arrow
from kmerloom.functions.dna import PACKED, PREFIX
from kmerloom.operators.kmers import SLICE, base_codes, check_k, kmer_occurrences, windows, with_bucket
from kmerloom.operators.prefix import exclusive_sum


def bucket_histogram(occurrences: DataFrame, k: int) -> DataFrame:
    """(bucket, n) of the occurrences."""
    return with_bucket(occurrences, k).groupBy("bucket").agg(F.count("*").alias("n"))


def _chunk_counts(k: int):
    """Rows (chunk_id, seq) sorted by chunk -> (chunk_id, bucket, n), each once. Counts of one chunk, a row per bucket at
    most, and the k-mers of a slice are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, open_rows = None, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            buckets, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return buckets, np.bincount(at, np.concatenate([n for _, n in held]), len(buckets)).astype(np.int64)

        def counted() -> pa.RecordBatch:
            buckets, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), chunk, np.int32)), pa.array(buckets.astype(np.int32)), pa.array(n)], names=["chunk_id", "bucket", "n"])

        for batch in batches:
            codes, ends = base_codes(batch)
            chunks = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            for a in range(0, len(codes), SLICE):
                _, read, kmer, *_ = windows(codes, ends, k, a, min(a + SLICE, len(codes)))
                if not len(read):
                    continue
                bucket, own = kmer.view(np.int64) >> 2 * max(0, k - PREFIX), chunks[read]
                cuts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)]
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if chunk is not None and own[x] != chunk:
                        yield counted()
                        held, open_rows = [], 0
                    chunk = int(own[x])
                    held.append(np.unique(bucket[x:y], return_counts=True))
                    open_rows += len(held[-1][0])
                    if open_rows > 1 << 22:
                        held = [summed()]
                        open_rows = len(held[0][0])
        if held:
            yield counted()

    return run


def chunk_bucket_histogram(reads: DataFrame, k: int, enumerate: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(chunk_id, bucket, n) of the k-mers of reads (chunk_id, seq), of all or of those that ``enumerate`` picks.

    The reads of a chunk, and not its k-mers, are brought together, and counted there. Picked k-mers and those of more
    than 31 bases go by rows, with their chunk's id for a read's, so nothing is joined.
    """
    if enumerate is None and k <= PACKED:
        check_k(k)
        met = reads.where(F.length("seq") > k).select(F.col("chunk_id").cast("int"), "seq").repartition("chunk_id").sortWithinPartitions("chunk_id")
        return map_arrow(met, _chunk_counts(k), "chunk_id int, bucket int, n long")
    found = with_bucket((enumerate or kmer_occurrences)(reads.select(F.col("chunk_id").cast("long").alias("read_id"), "seq"), k), k)
    return found.groupBy(F.col("read_id").cast("int").alias("chunk_id"), "bucket").agg(F.count("*").alias("n"))


def bucket_prefix_sum(histogram: DataFrame, bases: int = PREFIX) -> DataFrame:
    """(bucket, before): occurrences in smaller buckets, for every bucket that has any and for 4**bases (the total).

    Two levels: sums inside blocks of 1024 buckets, and before each block; no window spans more than 1025 rows.
    """
    h = histogram.select("bucket", "n").union(histogram.sparkSession.range(1).select(F.lit(4**bases).alias("bucket"), F.lit(0).cast("long").alias("n")))
    h = h.withColumn("block", F.expr("bucket div 1024"))
    blocks = h.groupBy("block").agg(F.sum("n").alias("own"))
    before = blocks.select("block", F.coalesce(F.sum("own").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return h.withColumn("inside", inside).join(before, "block").select("bucket", (F.col("base") + F.col("inside")).alias("before"))


def equal_frequency_ranges(histogram: DataFrame, parts: int, round_up: bool = True, bases: int = PREFIX) -> DataFrame:
    """(idx, bound): boundaries that cut the buckets in ``parts`` ranges of about equal counts; idx 0 is bound 0.

    Scanning buckets upwards, a boundary is set at the first bucket whose prefix sum reaches idx * average, one
    boundary per bucket at most. In closed form bound j is max over i <= j of m_i + j - i with m_i the first bucket that
    reaches i * average. Bounds beyond the last bucket are clamped to it. The average rounds up or down.
    """
    prefix = bucket_prefix_sum(histogram, bases)
    total = prefix.agg(F.max("before")).first()[0]
    average = max(1, math.ceil(total / parts) if round_up else total // parts)
    # the first bucket whose prefix sum is i * average or more follows the last bucket whose prefix sum is less
    upto = prefix.join(histogram.select("bucket", "n"), "bucket").select("bucket", F.expr(f"before div {average} + 1").alias("low"), F.expr(f"least((before + n) div {average}, {parts})").alias("high"))
    hits = upto.where("low <= high").select("bucket", F.explode(F.sequence("low", "high")).alias("i"))
    first = hits.groupBy("i").agg((F.min("bucket") + 1).alias("m"))
    every = histogram.sparkSession.range(1, parts + 1).select(F.col("id").alias("i")).join(first, "i", "left").select("i", F.coalesce("m", F.lit(4**bases)).alias("m"))
    bound = F.max(F.col("m") - F.col("i")).over(W.orderBy("i").rowsBetween(W.unboundedPreceding, 0)) + F.col("i")  # parts rows
    bounds = every.select(F.col("i").cast("int").alias("idx"), F.least(bound, F.lit(4**bases)).cast("int").alias("bound"))
    return bounds.union(histogram.sparkSession.range(1).select(F.lit(0).alias("idx"), F.lit(0).alias("bound")))


def reads_per_chunk(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n, first_read_id): rows of each chunk and the reads before it."""
    return exclusive_sum(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")), ["chunk_id"], "n", "first_read_id")
