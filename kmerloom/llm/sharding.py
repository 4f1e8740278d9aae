"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. They are dealt by hash into buckets of bounded size; inside a bucket every group
is a partial partition (its bytes in one of k subsets), and the two partial partitions of the largest spread are
combined again and again, the largest subset of one with the smallest of the other. What remains of a bucket is one
partial partition, and those of many buckets are differenced in the same way, level by level, until one is left: its
subsets are the shards. No task holds more than a bucket and the driver holds counts only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.storage import materialize

#: Groups of a bucket and partial partitions of a later level, on average; rows of one slot run.
BUCKET, FAN_IN, RUN = 20_000, 256, 100_000


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions, a (n, k) array of sums: the subset (0 to k - 1) where each one's column ends.

    Returns an (n, k) array; subset 0 has the largest sum. Ties go by position, so equal input gives equal output.
    """
    n, k = parts.shape
    heap, lists = [], {}
    for i in range(n):
        order = np.argsort(-parts[i], kind="stable")
        sums = parts[i][order]
        members = [[(i, int(c))] if parts[i][c] else [] for c in order]
        lists[i] = (sums, members, [(i, int(c)) for c in order if not parts[i][c]])
        heap.append((-(sums[0] - sums[-1]), i))
    heapq.heapify(heap)
    at = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ma, za), (sb, mb, zb) = lists.pop(a), lists.pop(b)
        sums = sa + sb[::-1]
        order = np.argsort(-sums, kind="stable")
        members = []
        for x in order.tolist():
            p, q = ma[x], mb[k - 1 - x]
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            members.append(p)
        if len(za) < len(zb):
            za, zb = zb, za
        za.extend(zb)
        sums = sums[order]
        lists[at] = (sums, members, za)
        heapq.heappush(heap, (-(sums[0] - sums[-1]), at))
        at += 1
    out = np.zeros((n, k), np.int64)
    if n:
        (_, members, _), = lists.values()
        for subset, found in enumerate(members):
            for i, c in found:
                out[i, c] = subset
    return out


def _bucket(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True]).reset_index(drop=True)
        parts = np.zeros((len(pdf), k), np.int64)
        parts[:, 0] = pdf["bytes"]
        pdf["subset"] = difference(parts)[:, 0]
        return pdf[["key", "node", "subset", "bytes", "copies"]]

    return run


def _level(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="node", columns="subset", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(k), fill_value=0)
        to = difference(grid.to_numpy(np.int64))
        frame = pd.DataFrame({"node": np.repeat(grid.index.to_numpy(np.int64), k), "subset": np.tile(np.arange(k), len(grid)), "new": to.ravel(), "bytes": grid.to_numpy(np.int64).ravel()})
        return frame.assign(parent=int(pdf["parent"].iloc[0]))

    return run


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, bucket: int = BUCKET, fan_in: int = FAN_IN, run_rows: int = RUN) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus ``overhead``; null counts as the empty text. Rows of equal texts share a
    shard. Sizes of shards are as near as the groups allow; one group larger than a fair share has a shard with little
    else. slot numbers the rows of a shard from 0 without gaps. An empty table gives an empty result; null doc_ids and
    repeated rows are placed like any other; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
    total, n = groups.agg(F.sum("copies"), F.count("*")).first()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    nodes = -(-n // bucket)
    placed = groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(nodes))).groupBy("node").applyInPandas(_bucket(shards), "key binary, node long, subset long, bytes long, copies long")
    placed = materialize(placed, "groups")
    sums = placed.groupBy("node", "subset").agg(F.sum("bytes").alias("bytes"))
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        step = materialize(sums.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(nodes))).groupBy("parent").applyInPandas(_level(shards), "node long, subset long, new long, bytes long, parent long"), "level")
        placed = placed.join(step.select("node", "subset", "new", "parent"), ["node", "subset"]).select("key", F.col("parent").alias("node"), F.col("new").alias("subset"))
        sums = step.groupBy(F.col("parent").alias("node"), F.col("new").alias("subset")).agg(F.sum("bytes").alias("bytes"))
    home = placed.select("key", F.col("subset").cast("int").alias("shard"))
    runs = max(1, total // (shards * run_rows))
    own = rows.join(home, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).alias("run"))
    own = materialize(own, "placed")
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    counts = own.groupBy("shard", "run").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).select("shard", "run", "first")
    within = W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    slot = F.col("first") + F.row_number().over(within) - 1
    return own.join(counts, ["shard", "run"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
